"""Settings: files, types, precedence, and the rules that they must meet."""

from __future__ import annotations

import json
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The candidates of a sweep that names none.
DEFAULT_CANDIDATES = [
    {"seed": 1, "controlnet_conditioning_scale": 1.0, "num_inference_steps": 30},
    {"seed": 2, "controlnet_conditioning_scale": 0.8, "num_inference_steps": 30},
    {"seed": 3, "controlnet_conditioning_scale": 0.7, "num_inference_steps": 25},
    {"seed": 4, "controlnet_conditioning_scale": 0.6, "num_inference_steps": 40},
    {"seed": 5, "controlnet_conditioning_scale": 0.5, "num_inference_steps": 20},
    {"seed": 6, "controlnet_conditioning_scale": 0.8, "num_inference_steps": 20},
]
CANDIDATE = "seed int, controlnet_conditioning_scale double, num_inference_steps int"


def read_map(spark: SparkSession, path: str) -> dict:
    """A flat map from a JSON or YAML file of any store that Spark reads; YAML needs its parser installed."""
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    if path.endswith(".json"):
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: no YAML parser is installed; use JSON") from e
    return yaml.safe_load(text) or {}


def coerced(default: object, value: object) -> object:
    """A text as the number that the option's default is; anything else as it is."""
    if isinstance(value, str) and isinstance(default, (int, float)) and not isinstance(default, bool):
        try:
            return type(default)(value)
        except ValueError:
            return value
    return value


def settled(defaults: dict, from_file: dict, explicit: dict) -> dict:
    """Options by precedence: what was given explicitly, then the file, then the default. Null in a file sets nothing, and a list is only replaced by a list."""
    out = dict(defaults)
    for k, v in from_file.items():
        known = defaults.get(k)
        if k in defaults and (v is None or isinstance(known, list) and known and not isinstance(v, list)):
            continue
        out[k] = coerced(known, v)
    return out | explicit


def one_source(dataset_root: str | None, dataset_name: str | None, train_data_dir: str | None) -> str:
    """Which of the three sources is set; none or several are an error."""
    given = [k for k, v in (("dataset_root", dataset_root), ("dataset_name", dataset_name), ("train_data_dir", train_data_dir)) if v]
    if len(given) != 1:
        raise ValueError(f"one source of data is needed, not {len(given)}: {', '.join(given) or 'none'}")
    return given[0]


def faults(options: dict) -> list[str]:
    """What is wrong with the options, in words; an empty list if nothing is."""
    o = options
    images, prompts = o.get("validation_image"), o.get("validation_prompt")
    kernel, scale = o.get("ra_fusion_kernel_size", 3), o.get("ra_fusion_scale", 1)
    rules = [
        ("resolution must be divisible by 8", o.get("resolution", 8) % 8 == 0),
        ("proportion_empty_prompts must be in [0, 1]", 0 <= o.get("proportion_empty_prompts", 0) <= 1),
        ("strength must be in (0, 1]", 0 < o.get("strength", 1) <= 1),
        ("rss_weight must be 0 or more", o.get("rss_weight", 0) >= 0),
        ("rss_threshold must be in [0, 1)", 0 <= o.get("rss_threshold", 0) < 1),
        ("validation_image and validation_prompt come together", (images is None) == (prompts is None)),
        ("one validation image, one prompt, or as many of both", not images or not prompts or len(images) == 1 or len(prompts) == 1 or len(images) == len(prompts)),
        *[(f"{k} must be above 0", o.get(k, 1) > 0) for k in ("ra_fusion_interval", "ra_fusion_hidden_dim", "ra_fusion_num_res_blocks")],
        ("ra_fusion_kernel_size must be odd and above 0", kernel > 0 and kernel % 2 == 1),
        ("ra_fusion_scale must be finite and 0 or more", isfinite(scale) and scale >= 0),
        ("a frozen control network needs controlnet_model_name_or_path", bool(not o.get("use_ra_fusion") or o.get("train_controlnet", True) or o.get("controlnet_model_name_or_path"))),
        ("train_transformer_lora needs use_transformer_lora", bool(not o.get("train_transformer_lora") or o.get("use_transformer_lora"))),
        ("report_to wandb and hub_token do not go together", not (o.get("report_to") == "wandb" and o.get("hub_token") is not None)),
    ]
    return [text for text, kept in rules if not kept]


def start_faults(options: dict) -> list[str]:
    """What keeps a run from starting: the faults of its options, no model, or not one source of data."""
    found = faults(options)
    if not options.get("pretrained_model_name_or_path"):
        found.append("pretrained_model_name_or_path is not set")
    try:
        one_source(*[options.get(k) for k in ("dataset_root", "dataset_name", "train_data_dir")])
    except ValueError as e:
        found.append(str(e))
    return found


def candidate_list(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """Candidates with `at`: of a JSON text, else of a file (JSON or YAML, a list), else the default list; checked like `candidates`."""
    if text is None and path:
        text = json.dumps(read_map(spark, path) or [])
    given = DEFAULT_CANDIDATES if text is None else json.loads(text)
    if not isinstance(given, list):
        raise ValueError("candidates must be a list")
    return candidates(spark.createDataFrame([(json.dumps(given),)], "value string"))


def candidates(texts: DataFrame, column: str = "value", schema: str = CANDIDATE) -> DataFrame:
    """at (from 0) and the fields of each candidate in JSON lists; a missing field is an error."""
    listed = texts.select(F.posexplode(F.from_json(column, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("at", "c")).select("at", "c.*")
    fields = [c for c in listed.columns if c != "at"]
    lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in fields])
    fault = F.concat(F.lit("candidate "), F.col("at").cast("string"), F.lit(" lacks "), lacks)
    return listed.withColumn("at", F.when(lacks == "", F.col("at")).otherwise(F.raise_error(fault)))

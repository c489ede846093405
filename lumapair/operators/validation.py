"""Step validation: from outputs of a model to the rows of a step log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumapair.functions import images, pixels
from lumapair.operators import pairing, reports


def step_validation(
    outputs: DataFrame, step: int, weathers: list, limit: int | None, size: int, key: str = "image_id", weather: str = "weather", pred: str = "pred", target: str = "target", height: str = "height",
    width: str = "width", channels: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(scores per image, step log rows) of a model's outputs and their targets.

    Of the named weathers, `limit` images each by the weather's own seed (all if None) are
    brought to size x size (short side, middle square) and scored by psnr and ssim. The log has the means
    per weather and their mean over weathers. Predictions that are null are left out.
    """
    own = outputs.where(F.col(weather).isin(weathers)).select(key, weather, pred, target, height, width)
    sampled = pairing.seeded_sample_per_group(own, weather, key, limit)
    ready = sampled
    for c in (pred, target):
        ready = images.with_prepared(ready, size, images.short_side_crop, c, height, width, f"_{c}", channels)
    scored = images.with_pair_score(ready, "ssim", images.ssim, f"_{pred}", f"_{target}", (channels, size, size)).where("ssim IS NOT NULL")
    per_image = scored.select(key, weather, pixels.psnr(F.col(f"_{pred}"), F.col(f"_{target}")).alias("psnr"), "ssim")
    per = per_image.groupBy(weather).agg(F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))
    return per_image, reports.step_scalars(per, step, weather)

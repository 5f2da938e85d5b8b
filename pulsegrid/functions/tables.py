"""Fixed reference tables: rigs, target signatures, perception criteria."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Sensor key, width px, height px, pixel pitch um, focal length mm, horizontal FOV deg
RIGS = [
    ("genx320", 320, 320, 6.3, 1.8, 58.0),
    ("imx636", 1280, 720, 4.86, 8.0, None),
]
# Horizontal FOV (deg) known per camera
CAMERA_FOV = {"cam1": 50.0}
# Signature, band low Hz, band high Hz, SNR gate, expects harmonics
SIGNATURES = [
    ("drone", 80.0, 800.0, 4.0, True),
    ("insect", 30.0, 250.0, 3.0, False),
    ("mosquito", 300.0, 800.0, 3.0, True),
    ("hummingbird", 15.0, 120.0, 3.0, False),
    ("bird", 3.0, 30.0, 2.5, False),
    ("custom", 10.0, 1000.0, 4.0, False),
]
# Pixels across the target for each perception task
JOHNSON_PX = {"detection": 2.0, "orientation": 2.8, "recognition": 8.0, "identification": 12.8}
# Fixed value: speed of sound, m/s
SOUND_MPS = 343.0


def rigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RIGS, "sensor string, width_px int, height_px int, pitch_um double, focal_mm double, fov_h double")


def signatures(spark: SparkSession) -> DataFrame:
    """One row per target class; harmonic gate 0.34 where overtones are expected."""
    return spark.createDataFrame(
        [(n, lo, hi, snr, h, 0.34 if h else 0.0) for n, lo, hi, snr, h in SIGNATURES],
        "signature string, freq_lo double, freq_hi double, snr_gate double, expect_harmonics boolean, "
        "harmonic_gate double")


def match_signatures(dets: DataFrame) -> DataFrame:
    """One row per detection (freq_hz, snr, harmonic) and target class whose band and gates it meets."""
    rows = F.array(*[F.struct(F.lit(n).alias("signature"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(g).alias("g"),
                              F.lit(0.34 if h else 0.0).alias("h")) for n, lo, hi, g, h in SIGNATURES])
    ok = F.filter(rows, lambda s: F.col("freq_hz").between(s["lo"], s["hi"]) & (F.col("snr") >= s["g"])
                  & (F.col("harmonic") >= s["h"]))
    return dets.withColumn("_s", F.explode(ok)).withColumn("signature", F.col("_s.signature")).drop("_s")

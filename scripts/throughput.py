"""Frames per second on generated audio: throughput.py [cores] [recordings] [seconds]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from wavelark.functions.spectral import power_spectrum  # noqa: E402
from wavelark.model import SIGNAL_SCHEMA  # noqa: E402
from wavelark.operators import doppler as V  # noqa: E402
from wavelark.operators import features as T  # noqa: E402
from wavelark.operators.framing import stft_frames  # noqa: E402
from wavelark.session import local_session, materialise  # noqa: E402

cores, count, seconds = (int(sys.argv[i]) if len(sys.argv) > i else d for i, d in ((1, 8), (2, 200), (3, 10)))
SR = 22050
spark = local_session(cores)
n = SR * seconds


def tones(batches):
    for batch in batches:
        for i in batch["id"]:
            x = 0.5 * np.sin(2 * np.pi * (i % 400 + 200) * np.arange(n) / SR)
            yield pd.DataFrame(
                {"recording_id": [str(i)], "class_name": ["c"], "channel": [0], "sr": [SR], "n_total": [n],
                 "start": [0], "own": [n], "samples": [x]}
            )


signals = materialise(spark.range(0, count, 1, 4 * cores).mapInPandas(tones, SIGNAL_SCHEMA))


def measure(name, df, frames):
    df.write.format("noop").mode("overwrite").save()
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - t
    print(f"\n{name:18s}{cores:3d} cores {frames:9d} frames {taken:7.2f} s {frames / taken:10.0f} frames/s", flush=True)


per = n // 512 + 1
measure("power_spectrum", stft_frames(signals).select(power_spectrum("samples", 2048)), count * per)
measure("feature_vectors", T.feature_vectors(signals), count * per)
track = (n - SR // 10) // (SR // 20) + 1
measure("full_doppler", V.doppler_summary(V.full_doppler(signals)), count * track)

"""Cut signals into frames and put frames back together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.model import SIGNAL_SCHEMA


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(int(value))


def seconds_to_samples(seconds: float) -> Column:
    """Whole samples in a duration at the row's own rate, truncated."""
    return F.floor(F.lit(float(seconds)) * F.col("sr")).cast("int")


def frames(
    signals: DataFrame,
    length: Column | int,
    hop: Column | int,
    count: Column,
    lead_in: Column | int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per frame; frame ``i`` begins at ``i*hop - lead_in``.

    ``keep`` names further columns to carry along.

    The chunk owning a frame's first sample cuts it, so framing is a map: no
    shuffle, however long the recording.  Samples outside the recording are 0.
    A chunk whose halo is too short for ``length`` fails; see ``with_halo``.
    """
    length, hop, lead_in = _column(length), _column(hop), _column(lead_in)
    zero = F.lit(0).cast("long")
    chunk_start, chunk_end = F.col("start"), F.col("start") + F.col("own")
    first = F.when(chunk_start == 0, F.lit(0)).otherwise(F.ceil((chunk_start + lead_in) / hop)).cast("long")
    last = F.least(count.cast("long") - 1, F.floor((chunk_end - 1 + lead_in) / hop).cast("long"))
    numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    silence = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    too_short = F.raise_error(F.lit("chunk halo shorter than the frame; call with_halo")).cast("array<double>")

    def cut(i: Column) -> Column:
        begin = i * hop - lead_in
        left = F.greatest(-begin, zero)
        inside = F.greatest(begin, zero)
        wanted = F.greatest(F.least(length - left, F.col("n_total") - inside), zero)
        offset = inside - chunk_start
        part = F.slice("samples", (offset + 1).cast("int"), wanted.cast("int"))
        frame = (
            F.when(F.size("samples") - offset < wanted, too_short)
            .when(wanted == length, part)
            .otherwise(F.concat(silence(left), part, silence(length - left - wanted)))
        )
        return F.struct(i.alias("frame_idx"), begin.cast("long").alias("start"), frame.alias("samples"))

    # The generator makes the frames, so its rows do not carry the whole chunk.
    about = ("recording_id", "class_name", "channel", "sr", "n_total")
    rows = signals.select(*about, *keep, F.explode(F.transform(numbers, cut)).alias("_frame"))
    return rows.select(*about, "_frame.frame_idx", "_frame.start", "_frame.samples", *keep)


def with_halo(signals: DataFrame, halo: int) -> DataFrame:
    """Give every chunk the next ``halo`` samples of its recording.

    Needed only for tables written without halo.  Chunks must have one size per
    recording (the last may be shorter).  Each chunk sends its head to the
    chunks before it, so a group never exceeds one chunk plus the halo.
    """
    keys = ["recording_id", "channel"]
    size = F.max("own").alias("_size")
    sized = signals.join(signals.groupBy(*keys).agg(size), keys)
    place = F.floor(F.col("start") / F.col("_size"))
    reach = F.ceil(F.lit(halo) / F.col("_size"))
    target = F.explode(F.sequence(F.greatest(place - reach, F.lit(0)), place))
    sent = sized.withColumn("_to", target)
    room = (F.col("_to") + 1) * F.col("_size") + halo - F.col("start")
    body = F.slice("samples", 1, F.least(F.col("own"), room).cast("int"))
    home = F.col("_to") == place
    return (
        sent.select(*keys, "_to", "class_name", "sr", "n_total", "start", "own", home.alias("_home"), body.alias("_body"))
        .groupBy(*keys, "_to")
        .agg(
            F.first("class_name").alias("class_name"),
            F.first("sr").alias("sr"),
            F.first("n_total").alias("n_total"),
            F.min("start").alias("start"),
            F.max(F.when(F.col("_home"), F.col("own"))).alias("own"),
            F.array_sort(F.collect_list(F.struct("start", "_body"))).alias("_parts"),
        )
        .select(
            "recording_id", "class_name", "channel", "sr", "n_total", "start", "own",
            F.flatten(F.transform("_parts", lambda p: p["_body"])).alias("samples"),
        )
    )


def own_samples(signals: DataFrame) -> DataFrame:
    """Long form: one row per sample, without halos."""
    return signals.select(
        "recording_id", "class_name", "channel", "sr", "start",
        F.posexplode(F.slice("samples", 1, F.col("own"))).alias("_pos", "value"),
    ).select(
        "recording_id", "class_name", "channel", "sr",
        (F.col("start") + F.col("_pos")).alias("idx"), "value",
    )


def sliding_windows(
    signals: DataFrame,
    window_s: float = 1.0,
    step_s: float = 0.5,
    inclusive: bool = False,
    rate: int | None = None,
) -> DataFrame:
    """Overlapping windows; by default a last window that fits exactly is left out.

    ``rate`` fixes the rate used to turn seconds into samples; ``None`` uses
    each recording's own.
    """
    if rate is None:
        width, step = seconds_to_samples(window_s), seconds_to_samples(step_s)
    else:
        width, step = F.lit(int(window_s * rate)), F.lit(int(step_s * rate))
    spare = F.col("n_total") - width - (0 if inclusive else 1)
    count = F.when(spare >= 0, F.floor(spare / step) + 1).otherwise(0)
    return frames(signals, width, step, count)


def chunked(signals: DataFrame, duration_s: float, overlap: float = 0.0) -> DataFrame:
    """Windows by duration and overlap ratio; tumbling when the ratio is 0."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return sliding_windows(signals, duration_s, duration_s * (1 - overlap), inclusive=True)


def stft_frames(signals: DataFrame, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """Centred frames: frame ``i`` is centred on sample ``i*hop``."""
    return frames(signals, n_fft, hop, F.floor(F.col("n_total") / hop) + 1, lead_in=n_fft // 2)


def overlap_add(pieces: DataFrame, block: int = 65536, halo: int = 0) -> DataFrame:
    """Sum overlapping output pieces back into signal chunks.

    ``pieces``: recording_id, class_name, channel, sr, n_total, start, samples
    and weight (the window power each sample got, for normalisation).  Every
    piece goes to the output blocks it touches; a block, with its halo, is one
    bounded group.
    """
    end = F.least(F.col("start") + F.size("samples"), F.col("n_total"))
    first = F.floor(F.greatest(F.col("start") - halo, F.lit(0)) / block)
    last = F.floor((end - 1) / block)
    routed = pieces.filter(end > 0).withColumn("_block", F.explode(F.sequence(first, last)))

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        head = part.iloc[0]
        begin = int(key[2]) * block
        own = int(min(block, head.n_total - begin))
        size = int(min(own + halo, head.n_total - begin))
        total, weight = np.zeros(size), np.zeros(size)
        for at, samples, power in zip(part["start"], part["samples"], part["weight"]):
            lo, hi = max(at, begin), min(at + len(samples), begin + size)
            if hi <= lo:
                continue
            total[lo - begin : hi - begin] += samples[lo - at : hi - at]
            weight[lo - begin : hi - begin] += power[lo - at : hi - at]
        samples = np.where(weight > 1e-8, total / np.maximum(weight, 1e-8), total)
        return pd.DataFrame(
            {
                "recording_id": [key[0]], "class_name": [head.class_name], "channel": [key[1]],
                "sr": [head.sr], "n_total": [head.n_total], "start": [begin], "own": [own],
                "samples": [samples],
            }
        )

    return routed.groupBy("recording_id", "channel", "_block").applyInPandas(add, SIGNAL_SCHEMA)

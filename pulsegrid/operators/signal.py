"""Signals of channels (by, idx, value): filters, phase, spectra, cross-spectra and coherence by chunks, and CSD as a plan.

Series are cut into chunks (operators/chunks.py), so no task holds a whole channel. by_channel() is for kernels of the caller that need one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import chunks as ch
from . import filters


#: Periods of a band's lower edge that a chunk sees on either side for its analytic signal.
PERIODS = 24


def second_difference(rows: DataFrame, step: int, pitch: float, by: Sequence[str] = ("idx",)) -> DataFrame:
    """(by, ch, csd): minus the second difference over channels `step` apart, over (step * pitch) squared."""
    by = list(by)
    at = lambda shift, name: rows.select(*by, (F.col("ch") + shift).alias("ch"), F.col("value").alias(name))
    both = rows.join(at(-step, "_up"), [*by, "ch"]).join(at(step, "_down"), [*by, "ch"])
    return both.select(*by, "ch", (-(F.col("_up") - 2 * F.col("value") + F.col("_down")) / (step * pitch) ** 2).alias("csd"))


def butter(order: int, cutoff: float | tuple[float, float], rate: float, kind: str = "lowpass") -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of a digital Butterworth filter, by the bilinear transform of the analogue prototype."""
    warped = 2 * rate * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / rate)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    zeros, gain = np.zeros(0, complex), 1.0
    if kind == "lowpass":
        poles, gain = poles * warped[0], gain * warped[0] ** order
    elif kind == "highpass":
        gain = float(np.real(1 / np.prod(-poles)))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), gain * width**order
    else:
        raise ValueError(kind)
    fs2 = 2 * rate
    gain *= float(np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles)))
    extra = len(poles) - len(zeros)
    z = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(extra)])
    return z, (fs2 + poles) / (fs2 - poles), gain


def frequency_response(zpk: tuple[np.ndarray, np.ndarray, float], freq: np.ndarray, rate: float) -> np.ndarray:
    z, p, k = zpk
    at = np.exp(2j * np.pi * freq / rate)[:, None]
    return k * np.prod(at - z[None, :], axis=1) / np.prod(at - p[None, :], axis=1)


def zero_phase(x: np.ndarray, zpk: tuple[np.ndarray, np.ndarray, float], rate: float, pad: int | None = None) -> np.ndarray:
    """x filtered forward and backward: its spectrum times the squared response, on an odd extension of both ends."""
    n = len(x)
    if n < 2:
        return x.astype(float)
    pad = min(n - 1, pad if pad is not None else 3 * max(8, int(rate)))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    spectrum = np.fft.rfft(wide)
    response = np.abs(frequency_response(zpk, np.fft.rfftfreq(len(wide), 1 / rate), rate)) ** 2
    return np.fft.irfft(spectrum * response, len(wide))[pad : pad + n]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal, by the spectrum without negative frequencies."""
    n = len(x)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * keep)


def slepian(n: int, nw: float, tapers: int) -> np.ndarray:
    """Discrete prolate spheroidal sequences: the first eigenvectors of the tridiagonal matrix that commutes with the band limit."""
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n)
    side = i[1:] * (n - i[1:]) / 2
    values, vectors = np.linalg.eigh(np.diag(main) + np.diag(side, 1) + np.diag(side, -1))
    out = vectors[:, np.argsort(values)[::-1][:tapers]].T
    for j, v in enumerate(out):
        if (j % 2 == 0 and v.sum() < 0) or (j % 2 == 1 and v[: n // 2].sum() < 0):
            out[j] = -v
    return out


def by_channel(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], by: Sequence[str], name: str = "value") -> DataFrame:
    """rows (by, idx, value) with the kernel of each group's values in the order of idx."""
    ship(rows.sparkSession)
    by = list(by)
    rows = rows.select(*by, "idx", F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "value")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        out = group.drop(columns="value")
        out[name] = kernel(group["value"].to_numpy())
        return out

    return rows.groupBy(*by).applyInPandas(run, f"{schema}, `{name}` double")


def filtered(rows: DataFrame, cutoff, rate: float, by: Sequence[str], order: int = 4, kind: str = "lowpass", chunk: int = ch.CHUNK) -> DataFrame:
    """(by, idx, value): zero-phase Butterworth filter of each channel, forward and backward with carried states. Null values are left out."""
    sos = filters.sections(butter(order, cutoff, rate, kind))
    packed = ch.pack(_numbers(rows, by), by, ["value"], chunk=chunk)
    return ch.unpack(filters.both_ways_chunked(packed, sos, by), by, ["value"])


def _numbers(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.select(*by, "idx", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")


def difference(rows: DataFrame, a: int, c: int, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, idx, value) of rows (by, channel, idx, value): channel a minus channel c, where both have a value; phase() takes it."""
    at = lambda n: F.max(F.when(F.col("channel") == n, F.col("value")))
    pair = rows.where(F.col("channel").isin(a, c)).groupBy(*by, "idx").agg(at(a).alias("_a"), at(c).alias("_c"))
    return pair.where("_a IS NOT NULL AND _c IS NOT NULL").select(*by, "idx", (F.col("_a") - F.col("_c")).alias("value"))


def _analytic_of_band(rows: DataFrame, band: tuple[float, float], rate: float, by: Sequence[str], order: int, chunk: int, name: str, take) -> DataFrame:
    """take(analytic signal) of each channel in a band. A chunk sees up to PERIODS periods of the band's lower edge on either side."""
    sos = filters.sections(butter(order, band, rate, "bandpass"))
    packed = ch.pack(_numbers(rows, by), by, ["value"], chunk=chunk)
    reach = int(np.ceil(PERIODS * rate / band[0]))
    return filters.reaching(filters.both_ways_chunked(packed, sos, by), by, reach, lambda x, a, b: take(analytic(x)), name)


def phase(rows: DataFrame, band: tuple[float, float], rate: float, by: Sequence[str], order: int = 3, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, idx, phase): wrapped phase of each channel in a band."""
    return _analytic_of_band(rows, band, rate, by, order, chunk, "phase", np.angle)


def envelope(rows: DataFrame, band: tuple[float, float], rate: float, by: Sequence[str], order: int = 3, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, idx, envelope): amplitude of each channel in a band."""
    return _analytic_of_band(rows, band, rate, by, order, chunk, "envelope", np.abs)


def whiten(x: np.ndarray, order: int = 2) -> np.ndarray:
    """Residuals of an autoregressive model by the Yule-Walker equations."""
    x = x - x.mean()
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)]) / len(x)
    if r[0] <= 0:
        return x
    system = r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
    a = np.linalg.solve(system + 1e-12 * r[0] * np.eye(order), r[1:])
    out = x.copy()
    for k in range(order):
        out[k + 1 :] -= a[k] * x[: len(x) - k - 1]
    return out


def whitened(rows: DataFrame, by: Sequence[str], order: int = 2, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, idx, value): whiten() of each channel by chunks; products at each lag are added by Spark. A constant channel is zero."""
    by = list(by)
    rows = _numbers(rows, by)
    centre = rows.groupBy(*by).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    rows = ch.meet(rows, centre, by).select(*by, "idx", F.when(F.col("_sd") < 1e-9, 0.0).otherwise(F.col("value") - F.col("_mean")).alias("value"))
    wide = filters.with_sides(ch.pack(rows, by, ["value"], chunk=chunk), by, ["value"], order, 0)
    keys = ch.keys(rows, by)

    def products(row: dict) -> dict:
        a, x = np.asarray(row["value_left"], float), np.asarray(row["value"], float)
        both = np.concatenate([np.zeros(order - len(a)), a, x])
        return {"r": [float(x @ both[order - k : len(both) - k]) for k in range(order + 1)]}

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        r = np.sum(np.stack(group["r"].map(np.asarray).to_list()), axis=0)
        a = np.zeros(order)
        if r[0] > 0:
            system = r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))]
            a = np.linalg.solve(system + 1e-12 * r[0] * np.eye(order), r[1:])
        return pd.DataFrame({"a": [a]})

    model = ch.scan(ch.each(wide, products, f"{keys}, bucket long, r array<double>"), by, solve, "a array<double>")

    def rest(row: dict) -> dict:
        x = np.concatenate([row["value_left"], row["value"]])
        out = x.copy()
        for k, c in enumerate(row["a"]):
            out[k + 1 :] -= c * x[: len(x) - k - 1]
        return {"value": out[len(row["value_left"]) :].tolist()}

    return ch.unpack(ch.each(ch.meet(wide, model, by), rest, f"{keys}, `idx` {wide.schema['idx'].dataType.simpleString()}, `value` array<double>"), by, ["value"])


def spectrogram(rows: DataFrame, rate: float, by: Sequence[str], length: int = 256, step: int = 128, nw: float = 3.0, n_fft: int | None = None, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, win, t, freq, power): multitaper power of each channel in overlapping windows, mean removed.

    Windows begin every `step` rows of a channel; those that its end would cut are left out.
    """
    by, n_fft = list(by), n_fft or length
    tapers = slepian(length, nw, max(1, int(2 * nw) - 1))
    freq = np.fft.rfftfreq(n_fft, 1 / rate)
    wide = filters.with_sides(ch.pack(_numbers(rows, by), by, ["value"], chunk=chunk), by, ["value"], 0, length - 1)

    def work(row: dict) -> dict:
        x = np.concatenate([row["value"], row["value_right"]])
        starts = filters.window_starts(row, length, step)
        pieces = x[starts[:, None] + np.arange(length)] if len(starts) else np.zeros((0, length))
        spectra = np.fft.rfft((pieces - pieces.mean(axis=1, keepdims=True))[:, None, :] * tapers, n_fft, axis=2)
        power = (np.abs(spectra) ** 2).mean(axis=1) / rate
        return {"win": ((starts + row["before"]) // step).tolist(), "power": power.tolist()}

    made = ch.each(wide, work, f"{ch.keys(rows, by)}, win array<long>, power array<array<double>>")
    made = made.select(*by, F.explode(F.arrays_zip("win", "power")).alias("w")).select(*by, "w.win", F.posexplode("w.power").alias("f", "power"))
    at = F.get(F.lit(freq.tolist()), F.col("f"))
    return made.select(*by, "win", ((F.col("win") * step + length / 2) / rate).alias("t"), at.alias("freq"), "power")


def resampled(rows: DataFrame, source: float, target: float, by: Sequence[str], chunk: int = ch.CHUNK) -> DataFrame:
    """(by, idx, value) at another rate: low-passed below the new limit, then read off by linear interpolation."""
    by = list(by)
    packed = ch.pack(_numbers(rows, by), by, ["value"], chunk=chunk)
    if target < source:
        packed = filters.both_ways_chunked(packed, filters.sections(butter(8, 0.45 * target, source)), by)
    wide = filters.with_sides(packed, by, ["value"], 0, 1)

    def work(row: dict) -> dict:
        x = np.concatenate([row["value"], row["value_right"]])
        # New rows whose place lies in this chunk, or after the last row of all.
        last = row["before"] + row["n"] == row["total"]
        first = int(np.ceil(row["before"] * target / source - 1e-9))
        stop = int(round(row["total"] * target / source)) if last else int(np.ceil((row["before"] + row["n"]) * target / source - 1e-9))
        at = np.arange(first, stop)
        return {"idx": at.tolist(), "value": np.interp(at * source / target - row["before"], np.arange(len(x)), x).tolist()}

    return ch.unpack(ch.each(wide, work, f"{ch.keys(rows, by)}, idx array<long>, value array<double>"), by, ["value"])


def _reaching(rows: DataFrame, by: Sequence[str], reach: int, mode: str, kernel: Callable[[np.ndarray], np.ndarray], chunk: int) -> DataFrame:
    """kernel of each channel with `reach` rows on either side; at a channel's ends they are made as np.pad does by mode."""

    def run(x: np.ndarray, before: int, after: int) -> np.ndarray:
        # Where a side has fewer rows than the reach, the channel ends there.
        wide = np.pad(x, (reach - before, reach - after), mode=mode)
        return np.concatenate([np.zeros(before), kernel(wide), np.zeros(after)])

    return filters.reaching(ch.pack(_numbers(rows, by), by, ["value"], chunk=chunk), by, reach, run)


def gaussian(rows: DataFrame, sigma: float, by: Sequence[str], chunk: int = ch.CHUNK) -> DataFrame:
    """Each channel smoothed by a Gaussian of sigma rows, ends mirrored."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    return _reaching(rows, by, r, "symmetric", lambda x: np.convolve(x, w, mode="valid"), chunk)


def boxcars(rows: DataFrame, width: int, times: int, by: Sequence[str], chunk: int = ch.CHUNK) -> DataFrame:
    """Each channel averaged over `width` rows (odd), `times` times, ends mirrored."""
    half = width // 2
    w = np.full(2 * half + 1, 1 / (2 * half + 1))
    for _ in range(times):
        rows = _reaching(rows, by, half, "symmetric", lambda x: np.convolve(x, w, mode="valid"), chunk)
    return rows


def fir(rows: DataFrame, taps: int, cutoff: float, rate: float, by: Sequence[str], chunk: int = ch.CHUNK) -> DataFrame:
    """Low-pass by a Hamming-windowed sinc of an odd number of taps, its delay taken out."""
    n = taps | 1
    t = np.arange(n) - n // 2
    h = np.sinc(2 * cutoff / rate * t) * np.hamming(n)
    h /= h.sum()
    return _reaching(rows, by, n // 2, "edge", lambda x: np.convolve(x, h, mode="valid"), chunk)


def cross_spectrogram(rows: DataFrame, rate: float, by: Sequence[str], length: int = 256, step: int = 128, nw: float = 3.0, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, win, t, ch1, ch2, freq, re, im): cross-spectrum of each two channels of rows (by, idx, ch, value), ch1 <= ch2, mean over tapers.

    Means of windows are removed. Rows in which a channel has no value are left out; the channels of all sessions are listed on the driver.
    """
    by = list(by)
    names = sorted(r.ch for r in rows.select(F.col("ch").cast("int").alias("ch")).where("ch IS NOT NULL").distinct().collect())
    columns = [f"c{i}" for i in range(len(names))]
    each = [F.max(F.when(F.col("ch") == c, F.col("value").cast("double"))).alias(n) for c, n in zip(names, columns)]
    if not names:
        each, columns, names = [F.max(F.col("value").cast("double")).alias("c0")], ["c0"], [0]
    packed = ch.pack(rows.groupBy(*by, "idx").agg(*each).dropna(subset=columns), by, columns, chunk=chunk)
    tapers = slepian(length, nw, max(1, int(2 * nw) - 1))
    freq = np.fft.rfftfreq(length, 1 / rate)
    one, two = np.triu_indices(len(columns))

    def work(row: dict) -> dict:
        x = np.stack([np.concatenate([row[c], row[f"{c}_right"]]) for c in columns])
        out = []
        for start in filters.window_starts(row, length, step).tolist():
            piece = x[:, start : start + length]
            f = np.fft.rfft((piece - piece.mean(axis=1, keepdims=True))[:, None, :] * tapers, axis=2)
            cross = (f[one] * f[two].conj()).mean(axis=1)
            out.append({"win": (start + row["before"]) // step, "re": cross.real.tolist(), "im": cross.imag.tolist()})
        return {"w": out}

    made = ch.each(filters.with_sides(packed, by, columns, 0, length - 1), work, f"{ch.keys(rows, by)}, w array<struct<win:long,re:array<array<double>>,im:array<array<double>>>>")
    pairs = made.select(*by, F.explode("w").alias("w")).select(*by, "w.win", F.posexplode(F.arrays_zip(F.col("w.re").alias("re"), F.col("w.im").alias("im"))).alias("p", "s"))
    bins = pairs.select(*by, "win", "p", F.posexplode(F.arrays_zip(F.col("s.re").alias("re"), F.col("s.im").alias("im"))).alias("f", "v"))
    pick = lambda xs, i: F.get(F.lit(list(xs)), F.col(i))
    return bins.select(
        *by, "win", ((F.col("win") * step + length / 2) / rate).alias("t"), pick([names[i] for i in one], "p").cast("int").alias("ch1"), pick([names[i] for i in two], "p").cast("int").alias("ch2"),
        pick(freq.tolist(), "f").alias("freq"), "v.re", "v.im",
    )


def _coherent(cross: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, ch1, ch2, freq, coherence, phase) of cross-spectra (on, ch1, ch2, freq, re, im)."""
    on = [*on, "freq"]
    own = cross.where("ch1 = ch2")
    power = lambda c, name: own.select(*on, F.col("ch1").alias(c), F.col("re").alias(name))
    both = cross.where("ch1 < ch2").join(power("ch1", "_a"), [*on, "ch1"]).join(power("ch2", "_b"), [*on, "ch2"])
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return both.select(*on[:-1], "ch1", "ch2", "freq", (size / F.greatest(F.sqrt(F.col("_a") * F.col("_b")), F.lit(1e-300))).alias("coherence"), F.atan2("im", "re").alias("phase"))


def coherogram(rows: DataFrame, rate: float, by: Sequence[str], length: int = 256, step: int = 128, nw: float = 3.0, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, win, t, ch1, ch2, freq, coherence, phase) of each window: of the mean over its tapers."""
    return _coherent(cross_spectrogram(rows, rate, by, length, step, nw, chunk), [*by, "win", "t"])


def coherence(rows: DataFrame, rate: float, by: Sequence[str], length: int = 256, step: int = 128, nw: float = 3.0, chunk: int = ch.CHUNK) -> DataFrame:
    """(by, ch1, ch2, freq, coherence, phase): multitaper coherence of channel pairs over all windows of rows (by, idx, ch, value)."""
    cross = cross_spectrogram(rows, rate, by, length, step, nw, chunk).groupBy(*by, "ch1", "ch2", "freq").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return _coherent(cross, by)


def spectrum(rows: DataFrame, rate: float, by: Sequence[str], **options) -> DataFrame:
    """(by, freq, power): mean of the spectrogram over its windows."""
    return spectrogram(rows, rate, by, **options).groupBy(*by, "freq").agg(F.avg("power").alias("power"))

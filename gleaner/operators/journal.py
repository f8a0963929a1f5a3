"""Journals of experiments folded in order: each entry against the last accepted one, a tag that comes again replacing its entry.

One journal is one group: its entries come in order, the state is what has been accepted so far, and nothing but a row for
each entry leaves the task. Intervals and tests resample the paired differences with a counter-based generator (a 32-bit
mix of seed, replicate and place), so SQL can repeat them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPTED, OPEN, REJECTED = "accepted", "not established", "rejected"
#: Values of one entry, a value for each query that was judged; more raise an error.
MOST = 1_000_000
COLUMNS = "place int, tag string, stage string, n long, mean double, compared_with string, common long, diff double, lo double, hi double, p double, verdict string"


def mixed(seed: int, rep: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32-bit numbers of replicates and places; `mixed_sql` gives the same."""
    m = np.uint64(0xFFFFFFFF)
    x = (np.uint64(seed * 2_654_435_761 % 2**32) + rep.astype(np.uint64) * np.uint64(2_246_822_519) + place.astype(np.uint64) * np.uint64(3_266_489_917)) & m
    for shift, factor in ((16, 2_246_822_507), (13, 3_266_489_909)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & m
    return x ^ (x >> np.uint64(16))


def mixed_sql(seed: int, rep: str, place: str) -> str:
    x = f"CAST(({seed * 2_654_435_761 % 2**32} + {rep} * 2246822519 + {place} * 3266489917) % 4294967296 AS UBIGINT)"
    for shift, factor in ((16, 2_246_822_507), (13, 3_266_489_909)):
        x = f"(xor({x}, {x} >> {shift}) * {factor} % 4294967296)"
    return f"xor({x}, {x} >> 16)"


def compared(d: np.ndarray, reps: int = 10_000, seed: int = 7, chunk: int = 4_000_000) -> tuple[float, float, float, float]:
    """(mean, lo, hi, p) of paired differences in the order of their keys: bootstrap interval of 95 per cent, and the share of random changes of sign that lead as far from zero."""
    n, real = len(d), d.mean()
    means, flips = [], []
    place = np.arange(n)[None, :]
    step = max(1, chunk // n)
    for lo in range(0, reps, step):
        rep = np.arange(lo, min(lo + step, reps))[:, None]
        means.append(d[(mixed(seed, rep, place) * np.uint64(n)) >> np.uint64(32)].mean(1))
        flips.append(np.where(mixed(seed + 1, rep, place) & np.uint64(1), d, -d).mean(1))
    means, flips = np.concatenate(means), np.concatenate(flips)
    return real, np.quantile(means, 0.025), np.quantile(means, 0.975), float((np.abs(flips) >= abs(real) - 1e-12).mean())


def verdict(diff: float, lo: float, hi: float, p: float, harmless: bool, level: float = 0.05) -> str:
    """Accepted: better, and the test says so; where `harmless` is enough, not worse or an interval that holds zero. Rejected: not better. Not established: the rest."""
    if harmless:
        return ACCEPTED if diff >= 0 or lo <= 0 <= hi else REJECTED
    return REJECTED if diff <= 0 else ACCEPTED if p < level else OPEN


def _fold(by: str, baseline: str, harmless: tuple[str, ...]):
    def run(pdf):
        import pandas as pd

        entries: dict[str, dict] = {}
        for r in pdf.sort_values("seq").itertuples():
            values = dict(zip(r.keys, r.values_))
            others = [e for e in entries.values() if e["tag"] != r.tag]
            before = next((e for e in reversed(others) if e["verdict"] == ACCEPTED), None) or next((e for e in others if e["tag"] == baseline), None)
            known = [v for v in values.values() if v is not None and v == v]
            e = {"tag": r.tag, "stage": r.stage, "n": len(known), "mean": np.mean(known) if known else None, "compared_with": None, "common": None, "diff": None, "lo": None, "hi": None, "p": None, "verdict": None}
            if before:
                pairs = [(values[k], before["values"][k]) for k in sorted(values.keys() & before["values"].keys())]
                d = np.array([a - b for a, b in pairs if None not in (a, b) and a == a and b == b])
                e |= {"compared_with": before["tag"], "common": len(d), "verdict": OPEN}
                if len(d):
                    found = compared(d)
                    e |= dict(zip(("diff", "lo", "hi", "p"), (round(float(x), 6) + 0.0 for x in found)), verdict=verdict(*found, r.stage in harmless))
            entries.pop(r.tag, None)
            entries[r.tag] = e | {"values": values}
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        out = pd.DataFrame([{**e, "place": i + 1, "mean": None if e["mean"] is None else round(float(e["mean"]), 6)} for i, e in enumerate(entries.values())], columns=names)
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return run


def folded(entries: DataFrame, values: DataFrame, by: str = "journal", baseline: str = "base", harmless: tuple[str, ...] = ("D",)) -> DataFrame:
    """`by` and COLUMNS: the journals as they stand after all entries, a row for each tag in the order of its last entry.

    entries: `by` (string), seq, tag, stage; values: `by`, seq, key, value (null where undefined). An entry is compared with the last
    accepted one of another tag, over the keys of both; where none is accepted with the baseline; the first has
    nothing to be compared with and no verdict. Stages in `harmless` only mustn't do harm. An entry without values keeps its row.
    """
    kept = values.groupBy(by, "seq").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct(F.col("key").cast("string").alias("k"), F.col("value").cast("double").alias("v")))).alias("x"))
    fits = F.when(F.col("c") > MOST, F.raise_error(F.lit(f"more than {MOST} values in an entry"))).otherwise(F.col("x"))
    rows = entries.join(kept.select(by, "seq", fits.alias("x")), [by, "seq"], "left")
    none = F.array().cast("array<string>"), F.array().cast("array<double>")
    rows = rows.select(by, "seq", "tag", "stage", F.coalesce("x.k", none[0]).alias("keys"), F.coalesce("x.v", none[1]).alias("values_"))
    return rows.groupBy(by).applyInPandas(_fold(by, baseline, harmless), f"{by} string, {COLUMNS}")

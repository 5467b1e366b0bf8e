"""Secrets in whole texts: fixed patterns, and strings that a battery of randomness tests takes for random.

A candidate is a maximal run of the characters of an encoding. Its encoding is
the smallest alphabet that fits it; strings of digits or of letters alone have
alphabets of their own. A run with one of / + - _ is also cut into its longest
pieces without - and _, without + and /, and without any of them, so that a key
behind a path or a prefix is tested by itself; a run that mixes + or / with - or
_ has no alphabet, only pieces. Pieces may overlap. Three tests ask whether its symbols are
drawn evenly from that alphabet: a chi-squared test of their frequencies, a
runs test around the middle of the alphabet, and the correlation of
neighbouring symbols. What ordinary text is like comes from the corpus itself:
counts of the letters of all candidates. The evidence of a candidate is how
seldom an ordinary string of its length would have a chi-squared value as small;
longer strings get more telling values. Among all candidates of the corpus the
false-discovery rate is held with the Benjamini-Hochberg rule on a fixed grid.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from plumbline.llm.frames import over_texts, settle, spare_name

#: fixed patterns; letters of the first in either case
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: words without which the first pattern cannot match
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
#: kinds in the order that breaks ties of the start
KINDS = ("assign", "access", "hex", "random")

#: encodings from the smallest alphabet to the largest
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "lower26": "abcdefghijklmnopqrstuvwxyz",
    "upper26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = list(ALPHABETS)
#: shortest candidate that the tests say anything about
SHORTEST = 20
#: only ASCII letters and digits border a run: a key may stand in unspaced text of any script
CANDIDATE = re.compile(r"(?<![^\W_])[A-Za-z0-9+/_-]{20,}={0,2}(?![^\W_])", re.A)
#: a run of / + - _ alone is ruling, which no encoding gives
SYMBOL = re.compile(r"[A-Za-z0-9]")
PIECES = [re.compile(p) for p in (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")]
#: a true random string fails one of the two tests of order this seldom
ORDER_LEVEL = 1e-4
#: share of false discoveries among all strings that are reported
FALSE_DISCOVERIES = 0.01
#: grid of evidence: tenths of a power of ten
GRID, GRID_TOP = 10, 300


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns as (start, end, kind)."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return found


def encoding_of(string: str) -> str | None:
    """The smallest alphabet that has all symbols."""
    symbols = set(string)
    return next((name for name, a in ALPHABETS.items() if symbols <= set(a)), None)


def normal_tail(z: float) -> float:
    """Chance of a standard normal value at least this far from zero."""
    return math.erfc(abs(z) / math.sqrt(2))


def measures(string: str, alphabet: str) -> tuple[float, float, float]:
    """Chi-squared value of evenness, and the chances under randomness of its runs and of its serial correlation."""
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in string])
    n, k = len(x), len(alphabet)
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    high = x >= k / 2
    above = int(high.sum())
    below = n - above
    if not above or not below:
        runs_p = 0.0
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * above * below / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = normal_tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centred = x - x.mean()
    power = float((centred**2).sum())
    if power == 0:
        serial_p = 0.0
    else:
        r = float((centred * np.roll(centred, 1)).sum()) / power
        serial_p = normal_tail((r + 1 / (n - 1)) * math.sqrt(n))
    return chi, runs_p, serial_p


def evidence(chi: float, n: int, shares: np.ndarray) -> float:
    """Minus the decimal logarithm of the chance that ordinary symbols have a chi-squared value this small.

    Under shares q of the symbols the value is about normal; its mean and
    variance follow from the multinomial moments and grow with the length.
    """
    k = len(shares)
    q = shares
    # value = k/n * sum(counts^2) - n
    mean = k * (1 + (n - 1) * float((q**2).sum())) - n
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    variance = (k / n) ** 2 * (2 * n * (n - 1) * s2 + 4 * n * (n - 1) * (n - 2) * s3 - 2 * n * (n - 1) * (2 * n - 3) * s2**2)
    z = (mean - chi) / math.sqrt(max(variance, 1e-9))
    if z <= 0:
        return 0.0
    if z < 30:
        return -math.log10(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))
    return min(GRID_TOP / GRID * 10.0, z * z / 2 / math.log(10))


def pieces(body: str) -> list[tuple[int, int]]:
    """(start, end) of the strings of a run that are tested: the run itself and its pieces, each once."""
    spans = {(0, len(body)): None}
    if not body.isalnum():
        spans |= {m.span(): None for p in PIECES for m in p.finditer(body)}
    return list(spans)


def candidates(text: str, shares: dict[str, np.ndarray]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, evidence) of each candidate; no evidence if its order is not random."""
    out = []
    for m in CANDIDATE.finditer(text):
        body = m[0].rstrip("=")
        for start, end in pieces(body):
            piece = body[start:end]
            name = encoding_of(piece)
            if name is not None and SYMBOL.search(piece):
                chi, runs_p, serial_p = measures(piece, ALPHABETS[name])
                ordered = min(runs_p, serial_p) < ORDER_LEVEL
                # padding belongs to the piece before it
                stop = m.end() if end == len(body) else m.start() + end
                out.append((m.start() + start, stop, name, 0.0 if ordered else evidence(chi, len(piece), shares[name])))
    return out


def symbol_shares(df: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Shares of the symbols in all words of all texts, for each encoding.

    Every task counts the bytes of its texts; one short row a task comes together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for buffer in batch.column(0).to_pylist():
                if buffer:
                    total += np.bincount(np.frombuffer(buffer, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    texts = df.select(df[f"`{text}`"].cast("string").cast("binary").alias("text"))
    rows = texts.mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    n = {chr(r.byte): r.n for r in rows}
    out = {}
    for name, alphabet in ALPHABETS.items():
        # words in one case have the letters of all words
        both = alphabet in (alphabet.upper(), alphabet.lower())
        counts = np.array([n.get(c, 0) + (n.get(c.swapcase(), 0) if both and c.isalpha() else 0) for c in alphabet], float) + 1
        out[name] = counts / counts.sum()
    return out


def scan(
    df: DataFrame, shares: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None, base_name: str = "base", candidates_name: str = "candidates"
) -> DataFrame:
    """Add ``base`` and ``candidates`` (or names given), arrays of structs with start and end in code points, from one pass over whole texts."""
    place = [StructField("start", IntegerType()), StructField("end", IntegerType())]
    base = ArrayType(StructType([*place, StructField("kind", StringType())]))
    tested = ArrayType(StructType([*place, StructField("encoding", StringType()), StructField("evidence", DoubleType())]))

    def listed(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
        flat = [x for r in rows for x in r]
        columns = list(zip(*flat)) if flat else [[] for _ in fields]
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values())], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    def run(texts: list[str | None]) -> list[pa.Array]:
        texts = [t or "" for t in texts]
        at = {"start": pa.int32(), "end": pa.int32()}
        return [
            listed([base_spans(t) for t in texts], at | {"kind": pa.string()}),
            listed([candidates(t, shares) for t in texts], at | {"encoding": pa.string(), "evidence": pa.float64()}),
        ]

    return over_texts(df, text, run, [StructField(base_name, base), StructField(candidates_name, tested)], keep)


def least_evidence(steps: dict[int, int], total: int, rate: float) -> float:
    """The smallest evidence on the grid at which the expected share of false discoveries is within the rate.

    ``steps`` has the number of candidates on each step of the grid; infinite if no step will do.
    """
    reached, limit = 0, math.inf
    for step in sorted(steps, reverse=True):
        reached += steps[step]
        if step > 0 and total * 10 ** (-step / GRID) <= rate * reached:
            limit = step / GRID
    return limit


def find_secrets(
    df: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES, keep: list[str] | None = None, spans: str = "spans"
) -> DataFrame:
    """Add ``spans`` (or a name given): an array of structs (start, end, kind), by start, then kind as listed, then end.

    Matches of the fixed patterns always stay. Kind ``random`` is added for
    candidates that the tests take for random and that touch no fixed match.
    Null and empty texts have no spans; an empty table gives an empty result.
    Other columns stay (or those in ``keep``), but for one with the name of the
    new one. Two passes read the texts: one counts symbols, one
    scans and is settled, so that the corpus-wide limit needs no third.
    """
    base, candidates = spare_name(df, "base"), spare_name(df, "candidates")
    scanned = settle(scan(df, symbol_shares(df, text), text, keep, base, candidates))
    each = scanned.select(F.explode(f"{candidates}.evidence").alias("evidence"))
    steps = each.groupBy(F.least(F.floor(F.col("evidence") * GRID), F.lit(GRID_TOP)).alias("step")).count().collect()
    numbers = {int(r["step"]): r["count"] for r in steps}
    limit = least_evidence(numbers, sum(numbers.values()), rate)
    random = F.filter(
        candidates,
        lambda c: (F.floor(c["evidence"] * GRID) >= F.lit(limit * GRID))
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    known = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), known[b["kind"]].alias("rank"), b["end"].alias("end"))),
        F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end"))),
    )
    names = F.array(*map(F.lit, KINDS))
    listed = F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind")),
    )
    return scanned.withColumn(spans, listed).drop(base, candidates)


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace the spans of each text, sorted as they are found, by a mark; all other text stays as it is.

    Spans that overlap share one mark. A null text stays null.
    """
    # pieces between the spans: each starts where the spans before it have ended
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(acc, s):
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["made"].alias("made"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["made"], gap, F.lit(mark)).alias("made"))
        )

    done = F.aggregate(
        spans, state, step, lambda acc: F.concat(acc["made"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text)))

"""Fill-in-the-middle: a text cut at two unit borders and put together anew, in one regular-expression match.

``regexp_count`` gives the number of units. A pattern made for the row holds
three groups, ``unit{a}``, ``unit{b-a}`` and the rest; the counted parts are
possessive, so the engine walks over them once, without a stack of ways back.
The replacement text puts the groups in their new order. All of it runs in the
JVM; no row moves to another task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.frames import spare_name

#: a line with its end, or the last one without
LINE = r"(?:[^\n]*+\n|[^\n]++)"


@dataclass(frozen=True)
class Marks:
    """Strings in front of the three parts; none may begin with the end of another or of itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]

    def check(self) -> None:
        for a in self.all():
            for b in self.all():
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")


def draw(doc_id: str, seed: int, k: int) -> Column:
    """The k-th whole number below 2^32 of a row, from the digest of seed and id; null without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{doc_id}`").cast("string")), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    unit: str = LINE,
    marks: Marks = Marks(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Each row draws four numbers from its id: two cuts between its n units, then
    whether it is cut at all (``fim_percent``), then the order of the parts
    (``spm_percent``). A null text counts as empty. Plain, with the text as it
    is, are empty texts, those that hold a mark, and rows without an id, which
    can draw nothing; their two lengths are null. Equal rows get equal results.
    Lengths are in code points. Columns of the frame with the names of the new
    ones are replaced; ``unit`` has no group of its own and needs at least one
    character.
    """
    marks.check()
    new = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    rows = df
    whole, low, high, drawn = (spare_name(df, name) for name in ("whole", "low", "high", "drawn"))
    rows = rows.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(whole),
        F.regexp_count(F.col(whole), F.lit(unit)).cast("long").alias("n"),
        F.array(*[draw(doc_id, seed, k) for k in range(4)]).alias(drawn),
    )
    h = [F.col(drawn)[k] for k in range(4)]
    cut = [h[k] % (F.col("n") + 1) for k in range(2)]
    has_mark = F.lit(False)
    for m in marks.all():
        has_mark = has_mark | F.contains(F.col(whole), F.lit(m))
    plain = h[0].isNull() | (F.col(whole) == "") | has_mark | (h[2] % 100 >= fim_percent)
    rows = rows.select(
        *[F.col(f"`{c}`") for c in kept], whole, "n",
        F.least(*cut).alias(low), F.greatest(*cut).alias(high),
        F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    pattern = F.concat(
        F.lit(f"(?s)\\A({unit}{{"), F.col(low).cast("string"), F.lit(f"}}+)({unit}{{"), (F.col(high) - F.col(low)).cast("string"), F.lit("}+)(.*)\\z")
    )
    p, s, m = (x.replace("\\", "\\\\").replace("$", "\\$") for x in marks.all())
    parts = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col(whole)).otherwise(F.regexp_replace(F.col(whole), pattern, parts))
    rows = rows.withColumn("output", output)
    # the marks are in no part, so the first of each is the one put in
    at = {x: F.locate(x, F.col("output")) for x in marks.all()}
    begin, end = at[marks.prefix] + len(marks.prefix), F.when(F.col("form") == "psm", at[marks.suffix]).otherwise(at[marks.middle])
    cut_up = F.col("form") != "plain"
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], "n", "form",
        F.when(cut_up, end - begin).cast("long").alias("prefix_chars"),
        F.when(cut_up, F.length("output") - at[marks.middle] - (len(marks.middle) - 1)).cast("long").alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text from an output and its form: the parts between the marks, in their old order."""
    p, s, m = (f"\\Q{x}\\E" for x in marks.all())
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

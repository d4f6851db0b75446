"""Quality rules: a table of thresholds compiled into one projection.

Everything is a Spark expression over the text; there is no user function, no
explode and no shuffle, so a document never leaves the task that read it.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.llm.common import BLANKS, bound

WINDOW = 8
#: The measures: of words, of lines, of the text.
MEASURES = (
    "n_words", "word_chars", "n_stop_words", "n_echoes", "n_repeat_words",
    "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_symbols", "n_shouts",
)
_PLACES = [("w" if k < 5 else "l" if k < 9 else "t", n) for k, n in enumerate(MEASURES)]
_BASE = "m.n_words < 20 OR 100 * m.n_repeat_words > 30 * m.n_words"


class Rule(NamedTuple):
    """Kept while low <= value <= high; a null value (0 / 0) passes."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Common function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the be to of and that have with is was for it on as at by this are from in or an a "
    "le la les de des du et un une en que qui pour dans est au par sur ne pas il "
    "der die das und ist in zu den von mit sich auf ein eine nicht im dem auch es an "
    "el los las y del se no su con una por lo como para al"
).split()

#: The last rule names; values are SQL over the measures below.
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "100 * n_repeat_words / nullif(n_words, 0)", high=30),
    Rule("word_length", "word_chars / nullif(n_words, 0)", low=2.0, high=14.0),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", low=0.02),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", high=0.5),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", high=0.3),
    Rule("echoes", "n_echoes / nullif(n_words, 0)", high=0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / nullif(n_lines, 0)", high=0.5),
    Rule("bullet_lines", "n_bullet_lines / nullif(n_lines, 0)", high=0.9),
)


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, str]:
    """Rule name -> SQL that tells whether measures `m` meet it."""
    out = {}
    for r in rules:
        value = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"m.\1", r.value)
        limits = [f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None)
        out[r.name] = f"coalesce({' AND '.join(limits) or 'true'}, true)"
    return out


def _words(text: Column) -> Column:
    core = F.trim(text, F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def _letters_of(text: Column, kind: str) -> Column:
    """How many characters of a kind; most texts have none and are only searched."""
    rest = F.length(F.regexp_replace(text, f"{kind}+", ""))
    return F.when(text.rlike(kind), F.length(text) - rest).otherwise(0).cast("long")


def _count(words: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(words, test)).cast("long")


def _starts(line: Column, *signs: str) -> Column:
    return functools.reduce(operator.or_, [F.startswith(F.ltrim(line), F.lit(s)) for s in signs])


def _ends(line: Column, *signs: str) -> Column:
    return functools.reduce(operator.or_, [F.endswith(F.rtrim(line), F.lit(s)) for s in signs])


def _repeated(words: Column) -> Column:
    """How many words lie inside runs of WINDOW words that occur twice or more."""

    def windows(h: Column) -> Column:
        def run(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])

        return F.slice(F.transform(h, run), F.lit(1), F.size(h) - (WINDOW - 1))

    def equal(s: Column) -> Column:
        def twin(e: Column, k: Column) -> Column:
            return (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])

        return F.array_sort(F.transform(F.filter(s, lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))

        def add(a: Column, p: Column) -> Column:
            return F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"]).cast("long")).alias("n"))

        return F.aggregate(places, start, add, lambda a: a["n"])

    def twice(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(bound(placed, equal)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = F.when(F.size(words) > WINDOW, bound(bound(hashes, windows), twice))
    return F.coalesce(found, F.lit(0).cast("long"))


def _measured(t: Column) -> Column:
    """All measures of a text as one struct: named twice, it is still worked out as one."""
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count(w, lambda x: x.isin(stop)).alias("n_stop_words"),
            F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_echoes"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(l: Column) -> Column:  # noqa: E741
        return F.struct(
            F.size(l).cast("long").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            _count(l, lambda x: _ends(x, "...", "…")).alias("n_ellipsis_lines"),
            _count(l, lambda x: _starts(x, "-", "•", "* ")).alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    return F.struct(
        bound(_words(t), of_words).alias("w"),
        bound(lines, of_lines).alias("l"),
        F.struct(
            _letters_of(t, "[#*$%&|<>]").alias("n_symbols"),
            F.regexp_count(t, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_shouts"),
        ).alias("t"),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the counts the rules are made of.

    Null and empty texts have no words and all counts 0. Repeated rows are
    measured each for itself; null ids stay. Other columns are not looked at, so
    their names cannot clash. Words are runs of anything but six ASCII blanks;
    lines are split at line feeds and count when they hold a word.

    Words inside repeated eight-word windows: words are hashed to 64 bits and
    each run of eight to another 64 bits; sorting (hash, place) inside the row
    finds the equal ones, and only in rows where the distinct hashes are fewer.
    """
    names = [f"_m.{k}.{n}" for k, n in _PLACES]
    measured = bound(F.coalesce(F.col(text_col), F.lit("")), _measured)
    return docs.select(F.col(id_col), measured.alias("_m")).select(id_col, *names)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The measures, base_failed, kept, and the names of the rules each row breaks."""
    tests = compiled(rules)
    fields = "".join(f"'{n}', m.{k}.{n}, " for k, n in _PLACES)
    flat = f"get(transform(array(_m), m -> named_struct({fields.rstrip(', ')})), 0)"
    broken = ", ".join(f"CASE WHEN NOT {ok} THEN '{name}' END" for name, ok in tests.items())
    kinds = f"'m', m, 'broken', array_compact(array({broken})), 'base_failed', {_BASE}"
    judged = f"get(transform(array({flat}), m -> named_struct({kinds})), 0)"
    last = "'kept', NOT j.base_failed AND size(j.broken) = 0"
    whole = f"get(transform(array({judged}), j -> named_struct('j', j, {last})), 0)"
    measured = bound(F.coalesce(F.col(text_col), F.lit("")), _measured)
    # One expression from text to verdict: a filter on any column copies it once, not once a mention.
    df = docs.select(F.col(id_col), measured.alias("_m")).select(id_col, F.expr(whole).alias("_j"))
    return df.select(id_col, "_j.j.m.*", "_j.j.broken", "_j.j.base_failed", "_j.kept")

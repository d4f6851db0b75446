"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from byte n-grams.  To it are
added how likely each language is to be declared as it was, how likely it is to
stand under the address suffix, and a prior of the host, smoothed towards its
domain and that towards all rows.  The tables of all three are grouped sums of
the posteriors that the texts alone give.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlab.llm.common import fold, shared_folder, written

#: Hash buckets of byte trigrams, and how many rows a parent level counts for.
BUCKETS, WEIGHT = 1 << 16, 5.0
#: Neighbouring trigrams overlap, so each tells a third.
TEMPER = 1 / 3

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible(page: str) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return html.unescape(_HIDDEN.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each three bytes of the lower-cased text."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    x = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _packed(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    data = [zlib.compress(x.tobytes(), 1) for x in total.values()]
    columns = [pa.array(list(total), pa.string()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "hits"])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            np.add.at(total[lang], trigrams(text.as_py()), 1)
    yield _packed(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.int64)
            total[lang] = total[lang] + x if lang in total else x
    yield _packed(total)


def text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, log probabilities by bucket): counted over all labelled rows outside the held-out fold.

    The model has a row per bucket and a column per language, whatever the corpus.
    """
    rows = docs.filter((fold(F.col(id_col)) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    kind = "lang string, hits binary"
    sums = rows.mapInArrow(_hits, kind).repartition("lang").mapInArrow(_added, kind)
    found = {r["lang"]: np.frombuffer(zlib.decompress(bytes(r["hits"])), np.int64) for r in sums.toLocalIterator()}
    langs = sorted(found)
    counts = np.stack([found[x] for x in langs], 1) + 0.5 if langs else np.zeros((BUCKETS, 0))
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _likelihoods(model, as_page: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = model.value
    for batch in batches:
        out = []
        for text in batch.column(1):
            text = text.as_py() or ""
            at = trigrams(visible(text) if as_page else text)
            total = np.zeros(table.shape[1])
            for k in range(0, len(at), 1 << 18):
                total += table[at[k : k + (1 << 18)]].sum(0, dtype=np.float64)
            out.append(total * TEMPER)
        columns = [batch.column(0), pa.array(out, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "_ll"])


def likelihoods(df: DataFrame, text_col: str, model, as_page: bool = False) -> DataFrame:
    """The other columns of `df` and ll, the tempered log likelihood of the whole text in each language."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    given = df.select(row.alias("_row"), F.col(text_col).alias("_text"))
    schema = T.StructType([given.schema["_row"], T.StructField("_ll", T.ArrayType(T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast(model[1])
    out = given.mapInArrow(functools.partial(_likelihoods, sent, as_page), schema)
    return out.select("_row.*", F.col("_ll").alias("ll"))


def declared_language(page: Column) -> Column:
    """The main part of the lang attribute of the html element, in lower case; empty without one.

    The element is the first html tag outside comments, however far into the page.
    """
    tag = F.regexp_extract(F.regexp_replace(page, r"(?s)<!--.*?(?:-->|\z)", " "), r"(?i)<html(?=[\s/>])[^>]*", 0)
    found = F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([a-z]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.coalesce(F.regexp_extract(host, r"\.([^.:]+)(?::\d+)?$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def _normal(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def _sums(df: DataFrame, key: list[str], n: int, name: str) -> DataFrame:
    """Rows and sums of q by key, as an array."""
    parts = [F.sum(F.col("q")[k]).alias(f"s{k}") for k in range(n)]
    out = df.groupBy(*key).agg(F.count("*").alias(f"{name}_n"), *parts)
    return out.select(*key, f"{name}_n", F.array(*[f"s{k}" for k in range(n)]).alias(name))


def fuse(df: DataFrame, langs: list[str]) -> DataFrame:
    """Adds lang, p, text_lang to rows with host, domain, suffix, declared and ll.

    A missing host, domain, suffix or declaration is the empty text, and tells
    what rows like it tell. A row's own posterior is left out of its host's and
    domain's sums. Ties go to the first language by name; without languages lang
    is null. Hot hosts are summed before they are shuffled.
    """
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return df.withColumns({"lang": none, "p": F.lit(None).cast("double"), "text_lang": none})
    df = df.withColumns({"q": _normal(F.col("ll"))})
    whole = _sums(df, [], n, "g").first()
    base = [(x + 1) / (whole["g_n"] + n) for x in (whole["g"] if whole["g_n"] else [0.0] * n)]
    prior = F.array(*map(F.lit, base))

    def toward(own: Column, count: Column, parent: Column) -> Column:
        return F.zip_with(own, parent, lambda s, b: (F.greatest(s, F.lit(0.0)) + WEIGHT * b) / (count + WEIGHT))

    totals = F.array(*[F.lit(float(x)) for x in (whole["g"] if whole["g_n"] else [0.0] * n)])
    def share(sums: str, values: int) -> Column:
        return F.zip_with(sums, totals, lambda s, t: F.log((s + 0.5) / (t + 0.5 * values)))

    told = df
    for name, key in (("d", "domain"), ("h", "host")):
        df = df.join(_sums(told, [key], n, name), key, "left")
    for key in ("declared", "suffix"):
        # log P(value | language), smoothed over the values there are.
        sums = _sums(told, [key], n, "v")
        df = df.join(sums.select(key, share("v", sums.count()).alias(f"from_{key}")), key, "left")

    def without(sums: str) -> Column:
        return F.zip_with(sums, "q", lambda a, b: a - b)

    def best(x: str) -> Column:
        return F.element_at(F.array(*map(F.lit, langs)), F.array_position(x, F.array_max(x)).cast("int"))

    domain = toward(without("d"), F.col("d_n") - 1, prior)
    df = df.withColumn("domain_prior", domain)
    df = df.withColumn("host_prior", toward(without("h"), F.col("h_n") - 1, F.col("domain_prior")))
    logits = F.zip_with("ll", F.transform("host_prior", lambda x: F.log(x)), lambda a, b: a + b)
    for key in ("declared", "suffix"):
        logits = F.zip_with(logits, f"from_{key}", lambda a, b: a + b)
    df = df.withColumn("post", _normal(logits))
    df = df.withColumns({"lang": best("post"), "p": F.array_max("post"), "text_lang": best("q")})
    return df.drop("q", "d", "d_n", "h", "h_n", "domain_prior", "host_prior", "from_declared", "from_suffix", "post")


def identify(texts: DataFrame, pages: DataFrame, model) -> DataFrame:
    """Rows of both frames with lang, p and text_lang.

    `texts` has id, host, text: plain text without address or declaration; its
    host is whatever names where it is from. `pages` has id, host, text: HTML.
    Null texts tell nothing and null hosts are empty. Likelihoods are written
    to the shared folder, as they are read for the sums and for the result.
    """
    plain = likelihoods(texts.withColumns({"declared": F.lit(""), "page": F.lit(False)}), "text", model)
    marked = pages.withColumns({"declared": declared_language(F.col("text")), "page": F.lit(True)})
    both = plain.unionByName(likelihoods(marked, "text", model, as_page=True))
    host = F.coalesce("host", F.lit(""))
    known = F.array(F.lit(""), *map(F.lit, model[0]))
    both = both.withColumns(
        {
            "host": host,
            "domain": F.when(F.col("page"), domain_of(host)).otherwise(host),
            "suffix": F.when(F.col("page"), suffix_of(host)).otherwise(F.lit("")),
            "declared": F.when(F.array_contains(known, F.col("declared")), F.col("declared")).otherwise("other"),
        }
    )
    return fuse(written(both, shared_folder(texts.sparkSession), "likelihoods"), model[0])

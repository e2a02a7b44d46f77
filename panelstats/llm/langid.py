"""Language identification by Bayesian fusion of evidence.

log P(language | page) = text + declaration + place, up to a constant, where

* text: tempered log likelihood of the byte trigrams under one multinomial model per language and a flat one for text in
  no known language (`und`); overlapping trigrams repeat each other, hence the temper;
* declaration: log P(declared markup language | language), from how declared values go with the text's languages over
  all rows;
* place: log P(language | host), smoothed over host, domain, address suffix and the whole table: each level's counts
  are mixed with its parent's distribution, which weighs as much as `strength` pages.

All counts are expected ones (sums of text posteriors) from grouped aggregation over all rows, and a row's own share is
taken out before it is used, so a row never confirms itself.
"""

from __future__ import annotations

import html as markup
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import whole_text
from panelstats.session import materialise

BUCKETS = 1 << 15
UNKNOWN = "und"
HIDDEN = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the text, A-Z lowered, with a blank at both ends."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace").lower() + b" ", np.uint8).astype(np.uint32)
    mixed = (raw[:-2] * np.uint32(0x01000193)) ^ (raw[1:-1] * np.uint32(0x0085EBCB)) ^ (raw[2:] * np.uint32(0x9E3779B1))
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = 4000) -> dict:
    """Trigram models of all labelled languages, each from about `sample_rows` of its rows, or all where it has fewer.

    A language's rows are drawn by a hash of id and text, at least one of each; repeated rows count once. Rows without
    label or id, or labelled as of no known language, are not used. What comes to the driver is one count per language,
    and per language and bucket.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                           whole_text(text_col).alias("text"))
    rows = rows.where((F.col("id").isNotNull()) & (F.col("lang") != UNKNOWN)).withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.groupBy("lang", "h").agg(F.count("*").alias("rows")).groupBy("lang").agg(
        F.count("*").alias("rows"), F.min("h").alias("lowest")).collect()  # one row per language
    ends = {r["lang"]: max(r["lowest"], min((1 << 63) - 1, (sample_rows << 64) // r["rows"] - (1 << 63))) for r in sizes}
    end = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])[F.col("lang")] if ends else F.lit(None)
    chosen = rows.where(F.col("h") <= end).dropDuplicates(["lang", "h"])

    def count(frames):
        import pandas as pd

        for frame in frames:
            for lang, group in frame.groupby("lang"):
                total = np.zeros(BUCKETS, np.int64)
                for text in group["text"]:
                    total += np.bincount(trigrams(text), minlength=BUCKETS)
                seen = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": seen, "n": total[seen]})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(ends)
    logs = np.full((BUCKETS, len(langs) + 1), -math.log(BUCKETS))
    for k, lang in enumerate(langs):
        part = table[table["lang"] == lang]
        n = np.full(BUCKETS, 0.05)
        n[part["bucket"].to_numpy(np.int64)] += part["n"].to_numpy(np.float64)
        logs[:, k] = np.log(n / n.sum())
    return {"langs": [*langs, UNKNOWN], "logs": logs.astype(np.float32)}


def _place(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix of an address; empty where there is none."""
    found = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = found[1].lower().strip(".") if found else ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def evidence(rows: DataFrame, model: dict, temper: float, has_markup: bool) -> DataFrame:
    """id, row_key, host, domain, suffix, declared, scores and soft (text posterior) of rows (id, row_key, text, url, host)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages x buckets

    def run(frames):
        import pandas as pd

        logs = shared.value["logs"]
        for frame in frames:
            out = []
            for number, key, text, url, host in zip(frame["id"], frame["row_key"], frame["text"], frame["url"], frame["host"]):
                declared = None
                if has_markup:
                    got = DECLARED.search(text)
                    declared = got[1].lower() if got else None
                    text = markup.unescape(HIDDEN.sub(" ", text))
                place = _place(url) if host is None else (host, host, "")
                scores = np.zeros(logs.shape[1])
                if text and not text.isspace():
                    scores = temper * logs[trigrams(text)].sum(axis=0, dtype=np.float64)
                soft = np.exp(scores - scores.max())
                out.append((number, key, *place, declared, scores.tolist(), (soft / soft.sum()).tolist()))
            yield pd.DataFrame(out, columns=["id", "row_key", "host", "domain", "suffix", "declared", "scores", "soft"])

    return rows.mapInPandas(run, "id long, row_key long, host string, domain string, suffix string, declared string, "
                                 "scores array<double>, soft array<double>")


def _sums(langs: int, name: str) -> Column:
    return F.array(*[F.sum(F.col("soft")[k]) for k in range(langs)]).alias(name)


def _without(total: Column, own: Column) -> Column:
    return F.zip_with(total, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def _mixed(counts: Column, parent: Column, strength: float) -> Column:
    """(counts + strength * parent) / (sum of counts + strength)"""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + strength
    return F.zip_with(counts, parent, lambda c, p: (c + p * strength) / total)


def identify(rows: DataFrame, model: dict, id_col: str, text_col: str, url_col: str | None = None,
             host_col: str | None = None, has_markup: bool = False, temper: float = 0.1, strength: float = 5.0,
             doubt: float = 0.5) -> DataFrame:
    """id, row_key, lang, posterior, text_lang, declared, host, accepted for every row.

    row_key is a hash of the text, so that (id, row_key) tells rows apart. A missing or empty text has no text
    evidence; a missing address, host or declaration adds none. accepted: the language is known and its posterior is
    above `doubt`, and the text is not blank. Ties go to the language first in the alphabet. An empty table gives none.
    """
    langs = model["langs"]
    n = len(langs)
    text = whole_text(text_col)
    url = F.col(f"`{url_col}`").cast("string") if url_col else F.lit(None).cast("string")
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")) if host_col else F.lit(None).cast("string")
    data = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"),
                       url.alias("url"), host.alias("host"))
    seen = materialise(evidence(data, model, temper, has_markup), "evidence")

    hosts = seen.groupBy("host", "domain", "suffix").agg(_sums(n, "of_host"))
    level = lambda keys, by, name: hosts.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(by)[k]) for k in range(n)]).alias(name))
    everything = level([], "of_host", "of_all")
    whole = everything.first()["of_all"] or [0.0] * n  # one row
    if whole[0] is None:
        whole = [0.0] * n
    places = (
        hosts.join(level(["suffix"], "of_host", "of_suffix"), "suffix")
        .join(level(["domain"], "of_host", "of_domain"), "domain")
        .select("host", "of_host", "of_domain", "of_suffix")
    )
    says = seen.where("declared is not null").groupBy("declared").agg(_sums(n, "of_declared"))
    spread = says.agg(*[F.sum(F.col("of_declared")[k]).alias(f"s{k}") for k in range(n)], F.count("*").alias("values")).first()
    said = [spread[k] or 0.0 for k in range(n)]
    values = spread["values"] + 1  # one more for what has not been declared yet

    both = seen.join(places, "host").join(says, "declared", "left")
    soft, ones = F.col("soft"), F.array(*[F.lit(1.0 / n)] * n)
    total = _mixed(_without(F.array(*[F.lit(float(x)) for x in whole]), soft), ones, 1.0)
    by_suffix = _mixed(_without(F.col("of_suffix"), soft), total, strength)
    by_domain = _mixed(_without(F.col("of_domain"), soft), by_suffix, strength)
    by_host = _mixed(_without(F.col("of_host"), soft), by_domain, strength)
    declared = F.when(
        F.col("declared").isNotNull(),
        F.zip_with(_without(F.col("of_declared"), soft), _without(F.array(*[F.lit(float(x)) for x in said]), soft),
                   lambda c, t: F.log((c + 1.0) / (t + float(values)))),
    ).otherwise(F.array(*[F.lit(0.0)] * n))
    logs = F.zip_with(F.zip_with("scores", by_host, lambda s, p: s + F.log(p)), declared, lambda a, b: a + b)
    both = both.withColumn("logs", logs)
    best = F.array_max("logs")
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    blank = F.array_max("scores") == F.array_min("scores")
    both = both.select("id", "row_key", pick("logs").alias("lang"), (1.0 / mass).alias("posterior"),
                       F.when(~blank, pick("scores")).alias("text_lang"), "declared", "host", blank.alias("blank"))
    return both.withColumn("accepted", ~F.col("blank") & (F.col("lang") != UNKNOWN) & (F.col("posterior") > doubt)).drop("blank")

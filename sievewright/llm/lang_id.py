"""Language identification by fusing evidence: text, declared markup language, address, and the host's habits.

Text: naive Bayes over hashed trigrams of bytes, of words of letters. It is fitted on labelled rows, about TRAIN_ROWS of
each language at most (picked by a hash of the row's id), for every label there is: a label costs 256 KB of the model; a hypothesis "und" holds uniform text. Everything else covers
all rows: each host's prior is smoothed towards its parent domain's, and that towards the corpus's, from grouped counts of
the languages that texts alone point to. The posterior is proportional to prior * text ** TEMPER * declared * address.

A row is rejected if it has no letters, or "und" is likeliest, or the best posterior is below LEAST.
Null and empty texts have no letters: language null, probability 0. Null hosts, declarations and addresses say nothing.
Texts of any length are read whole. Of equally likely languages the first in sorted order is named, "und" last. Rows are
judged one by one, so repeated rows get equal answers. With no labelled row at all every row is rejected; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, salted, shielded, stored

TRAIN_ROWS, BUCKETS = 1500, 1 << 16
TEMPER, LEAST, STRENGTH = 1 / 3, 0.5, 20.0
#: Probability that a declared language, or one in an address, is the text's.
DECLARED, ADDRESS = 0.9, 0.7
UNKNOWN = "und"
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of bytes, with one blank around words of letters; none for a text without letters."""
    words = (text or "").encode().translate(_LETTERS).split()
    if not words:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b"  " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    x = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    return (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)


class Model:
    """Log-likelihoods of trigrams under each language, "und" last."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + 0.2
        table = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))
        self.table = np.vstack([table, np.full((1, BUCKETS), -np.log(20_000))]).T.astype(np.float32)

    def likelihood(self, text: str | None) -> tuple[np.ndarray, int]:
        """Tempered log-likelihoods and the number of trigrams."""
        t = trigrams(text)
        return self.table.take(t, 0).sum(0, dtype=np.float64) * TEMPER, len(t)


def fit(rows: DataFrame, identity: str = "doc_id", label: str = "lang", text: str = "text") -> Model:
    """The text model, from a bounded sample of labelled rows."""
    sizes = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, TRAIN_ROWS / n) * 2**30))))
    picked = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(identity).alias("id")).where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < F.coalesce(F.element_at(share, F.col("label")), F.lit(0)))

    def count(batches):
        for b in batches:
            got: dict[str, list] = {}
            for k, x in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                got.setdefault(k, []).append(trigrams(x.as_py()))
            for k, parts in got.items():
                n = np.bincount(np.concatenate(parts), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["label", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS), np.float32)
    place = {k: i for i, k in enumerate(languages)}
    got = picked.select("label", "text").mapInArrow(lean(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[[place[k] for k in got.column("label").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts)


#: Priors of all hosts up to this size go to every task.
PRIORS_BYTES = 4 << 20


def parent(host: Column) -> Column:
    """The last two labels of a host name with dots; null for one without."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -2))


def scored(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """rows with _sw_ll (tempered log-likelihood of the text under each language of the model; null without letters)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names, kinds = rows.columns, dict(rows.dtypes)

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            for x in b.column(text):
                ll, n = m.likelihood(x.as_py())
                out.append(ll if n else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "_sw_ll"])

    return rows.mapInArrow(lean(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "_sw_ll array<double>"]))


def _best(c: Column | str) -> Column:
    """Place, from 0, of the greatest of an array; of equal ones the first."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def _share(c: Column | str) -> Column:
    return F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))


def priors(votes: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """host and prior (over size languages) from all rows (host, vote: the language that the text alone points to), and the corpus's prior."""
    counts = stored(votes.where("vote is not null").groupBy("host", "vote").agg(F.count("*").alias("n")), "votes")
    times = {r.vote: r.n for r in counts.groupBy("vote").agg(F.sum("n").alias("n")).collect()}
    all_ = sum(times.values()) + size
    base = [(times.get(k, 0) + 1) / all_ for k in range(size)]
    whole = F.array(*(F.lit(p) for p in base))
    known = counts.where("host is not null").withColumn("parent", parent(F.col("host")))

    def smooth(rows: DataFrame, key: str) -> DataFrame:
        """key, and its number of rows for each language."""
        summed = rows.groupBy(key, "vote").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("m"))
        return summed.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)).cast("double"))).drop("m")

    towards = lambda above: F.zip_with("c", above, lambda n, p: n + p * STRENGTH)
    above = smooth(known.where("parent is not null"), "parent").select("parent", _share(towards(whole)).alias("above"))
    hosts = smooth(known, "host").withColumn("parent", parent(F.col("host"))).join(above, "parent", "left")
    return stored(hosts.select("host", _share(towards(F.coalesce("above", whole))).alias("prior")), "priors"), base


def _with_evidence(total: Column, place: Column, right: float, size: int) -> Column:
    """Log posteriors after evidence for the language at this place, from 1; null and 0 say nothing."""
    yes, no = float(np.log(right)), float(np.log((1 - right) / (size - 1)))
    return F.when(F.coalesce(place, F.lit(0)) > 0, F.transform(total, lambda x, k: x + F.when(k + 1 == place, yes).otherwise(no))).otherwise(total)


def identify(rows: DataFrame, model: Model, keep: list[str], host: str, declared: str | None = None, address: str | None = None, text: str = "text", priors_bytes: int = PRIORS_BYTES) -> DataFrame:
    """The kept columns with _sw_language, _sw_probability, _sw_text_language and _sw_rejected. host, declared and address name columns, the latter two of language codes.

    Texts are scored once; the scores are stored with the kept columns, and all evidence is fused by SQL functions. Priors of up to
    `priors_bytes` are broadcast; more of them are joined by host, frequent hosts dealt out.
    """
    size = len(model.languages)
    given = [(c, r, f"_sw_given_{k}") for k, (c, r) in enumerate(((declared, DECLARED), (address, ADDRESS))) if c]
    asked = rows.select(*dict.fromkeys([*keep, text]), *(F.col(c).cast("string").alias(as_) for c, _, as_ in given), F.col(host).cast("string").alias("_sw_host"))
    table = stored(scored(asked, model, text).select(*keep, *(as_ for _, _, as_ in given), "_sw_host", "_sw_ll"), "scored")
    prior, base = priors(table.select(F.col("_sw_host").alias("host"), _best("_sw_ll").alias("vote")), size)
    prior = prior.select(F.col("host").alias("_sw_host"), F.col("prior").alias("_sw_prior"))
    few = prior.limit(most := priors_bytes // (8 * size)).count() < most  # then no text has to move to its host's prior
    joined = table.join(F.broadcast(prior), ["_sw_host"], "left") if few else salted(table, prior, ["_sw_host"], "left")
    whole = F.array(*(F.lit(p) for p in base))
    total = F.zip_with("_sw_ll", F.coalesce("_sw_prior", whole), lambda x, p: x + F.log(p))
    names = F.array(*(F.lit(x) for x in model.languages))
    for _, right, as_ in given if size > 1 else ():
        total = _with_evidence(total, F.array_position(names, F.substring_index(F.lower(F.col(as_)), "-", 1)), right, size)
    out = joined.withColumn("_sw_total", total).withColumn("_sw_at", _best("_sw_total"))
    out = out.withColumn("_sw_probability", F.lit(1.0) / F.aggregate("_sw_total", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("_sw_total"))))
    found = F.col("_sw_ll").isNotNull() & F.lit(size > 1)
    when = lambda c: F.when(found, c)
    return out.select(
        *keep,
        when(F.get(names, F.col("_sw_at"))).alias("_sw_language"),
        F.coalesce(when(F.col("_sw_probability")), F.lit(0.0)).alias("_sw_probability"),
        when(F.get(names, _best("_sw_ll"))).alias("_sw_text_language"),
        F.coalesce(when((F.col("_sw_at") == size - 1) | (F.col("_sw_probability") < LEAST)), F.lit(True)).alias("_sw_rejected"),
    )


def accepted(docs: DataFrame, identity: str = "doc_id", label: str = "lang", host: str = "source") -> DataFrame:
    """The rows whose language is found, with all their columns."""
    docs, restore = shielded(docs)
    return restore(identify(docs, fit(docs, identity, label), docs.columns, host).where("not _sw_rejected").select(*docs.columns))


# Endings of addresses, and the language of most pages there.
ENDINGS = {
    "ar": "es", "at": "de", "au": "en", "bg": "bg", "br": "pt", "by": "ru", "ca": "en", "cl": "es", "cn": "zh", "co": "es",
    "cz": "cs", "de": "de", "dk": "da", "ee": "et", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hk": "zh", "hr": "hr",
    "hu": "hu", "id": "id", "ie": "en", "il": "he", "ir": "fa", "is": "is", "it": "it", "jp": "ja", "kr": "ko", "lt": "lt",
    "lv": "lv", "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "rs": "sr",
    "ru": "ru", "se": "sv", "si": "sl", "sk": "sk", "th": "th", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en",
    "uy": "es", "ve": "es", "vn": "vi", "za": "en",
}


_HTML_LANG = r"""(?is)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})"""


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, host, text without markup, declared language, and the language that the address names: a path part of two letters, else a country ending."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    ending = F.element_at(F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair)), F.substring_index(host, ".", -1))
    blank = lambda c: F.when(c != "", c)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "(?s)<[^>]*>", " ")
    return pages.select("page_id", blank(host).alias("host"), text.alias("text"), blank(F.lower(F.regexp_extract("html", _HTML_LANG, 1))).alias("declared"), F.coalesce(blank(path), F.when(F.instr(host, ".") > 0, ending)).alias("address"))

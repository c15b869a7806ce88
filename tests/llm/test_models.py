"""Language-model scores, language ID, neighbours and the pipeline."""

import math
import random
from collections import Counter

import nasty
import numpy as np
import pytest
from pyspark.sql import functions as F
from sievewright.llm import ann, lang_id, lm_score, queries
from sievewright.llm.common import alnum_words

DATA = "/root/testdata/sf0.001"


def losses(rows, target):
    words = [alnum_words((t or "").encode()) for _, t in rows]
    n = Counter(w for x in words for w in x)
    held = {w for w, c in n.items() if c >= lm_score.RARE * sum(n.values())}
    coded = [[w if w in held else None for w in x] for x in words]

    def model(of):
        one = Counter(w for x in of for w in x)
        two = Counter(p for x in of for p in zip(x, x[1:], strict=False))
        p = lambda w: (one[w] + 1) / (sum(one.values()) + len(held) + 1)
        return lambda x: sum(-math.log(p(w) if not k else (two[x[k - 1], w] + lm_score.MASS * p(w)) / (one[x[k - 1]] + lm_score.MASS)) for k, w in enumerate(x)) / len(x)

    t, b = model([x for x, (i, _) in zip(coded, rows, strict=True) if i in target]), model(coded)
    return [(i, len(x), t(x) if x else None, b(x) if x else None) for x, (i, _) in zip(coded, rows, strict=True)]


@pytest.mark.parametrize(("rare", "common", "broadcast"), [(2e-5, 1 / 400, 32 << 20), (0.01, 0.03, 0)])
def test_scores_by_brute_force(spark, monkeypatch, rare, common, broadcast):
    monkeypatch.setattr(lm_score, "RARE", rare)
    monkeypatch.setattr(lm_score, "COMMON", common)
    monkeypatch.setattr(lm_score, "BROADCAST", broadcast)
    monkeypatch.setattr(lm_score, "BATCH", 7)
    docs = nasty.documents(spark)
    target = spark.createDataFrame([(i,) for i in (3, 5, 16, 20, 21, 22, 22, None)], "doc_id long")
    key = lambda r: (str(r[0]), r[1], round(r[2] or 0, 4), round(r[3] or 0, 4))
    got = sorted((tuple(r)[:4] for r in lm_score.score(docs, target).collect()), key=key)
    want = sorted(losses([(r.doc_id, r.text) for r in docs.collect()], {3, 5, 16, 20, 21, 22}), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or (abs(a[2] - b[2]) < 1e-5 and abs(a[3] - b[3]) < 1e-5)


@pytest.mark.parametrize("head", [2e-5, 0.01, 1.0])
def test_scores_tell_all_words_apart(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head, raising=False)
    monkeypatch.setattr(lm_score, "COMMON", 0.03)
    monkeypatch.setattr(lm_score, "BATCH", 7)
    rnd = random.Random(3)
    # One word so frequent that words of three occurrences are under 2e-5 of all.
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" if rnd.random() < 0.7 else "the" for _ in range(rnd.randrange(1, 30)))) for i in range(60)]
    rows += [(100 + i, "the " * 6000) for i in range(30)] + [(200, "w1 w2 w3"), (201, "once the w1"), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [alnum_words(t.encode()) for _, t in rows]
    target = set(range(0, 60, 3)) | {200}
    held = {w for x in words for w in x}

    def model(of):
        one, two = Counter(w for x in of for w in x), Counter(p for x in of for p in zip(x, x[1:], strict=False))
        p = lambda w: (one[w] + 1) / (sum(one.values()) + len(held) + 1)
        return lambda x: sum(-math.log(p(w) if not k else (two[x[k - 1], w] + lm_score.MASS * p(w)) / (one[x[k - 1]] + lm_score.MASS)) for k, w in enumerate(x)) / len(x)

    t, b = model([x for x, (i, _) in zip(words, rows, strict=True) if i in target]), model(words)
    got = {r.doc_id: r for r in lm_score.score(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for x, (i, _) in zip(words, rows, strict=True):
        assert got[i].n_words == len(x) and (not x or (abs(got[i].target_loss - t(x)) < 1e-5 and abs(got[i].background_loss - b(x)) < 1e-5))


def test_scores_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(nasty.empty(spark), none).count() == 0
    scored = lm_score.score(nasty.documents(spark), none).where("n_words > 0")
    assert scored.where("target_loss is null or isnan(target_loss)").count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    found = lang_id.identify(rest, lang_id.fit(train), ["doc_id", "lang"], "source").collect()
    right = sum(r.lang == r._sw_language and not r._sw_rejected for r in found)
    assert len(found) == rest.count() and right / len(found) >= 0.98


def test_every_label_is_a_language(spark):
    rnd = random.Random(7)
    names = [f"l{k}" for k in range(80)]
    words = {n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for n in names}
    # The later a label, the rarer.
    rows = [(k * 1000 + i, " ".join(rnd.choice(words[n]) for _ in range(40)), n, "h") for k, n in enumerate(names) for i in range(10 - k // 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lang_id.fit(docs)
    assert set(model.languages) == {*names, "und"}
    found = lang_id.identify(docs, model, ["doc_id", "lang"], "source").collect()
    assert len(found) == len(rows) and all(r.lang == r._sw_language and not r._sw_rejected for r in found)
    assert lang_id.accepted(docs).count() == len(rows)


def test_language_of_nasty_documents(spark):
    docs = nasty.documents(spark)
    found = lang_id.identify(docs, lang_id.fit(docs), docs.columns, "source")
    assert found.count() == docs.count()
    for r in found.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert r._sw_rejected and r._sw_language is None and r._sw_probability == 0
    kept = lang_id.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert lang_id.accepted(nasty.empty(spark)).count() == 0
    assert lang_id.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_evidence_moves_the_answer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs)
    rows = [(1, "de", "h.example.com", None, None), (2, "de", "h.example.com", "fr", "fr"), (3, "de", None, "xx", None)]
    df = spark.createDataFrame(rows, "id int, text string, host string, declared string, address string")
    got = {r.id: r._sw_language for r in lang_id.identify(df, model, ["id"], "host", "declared", "address").collect()}
    assert got[2] == "fr"
    pages = spark.createDataFrame([(1, "https://u@www.site.de:80/x", "<html><p>a</p>"), (2, "http://a.com/fr/825?x#y", "<HTML class='q' LANG='en-GB'><script>var t='</p>'</script>hi <b>you</b>"), (3, None, None)], "page_id int, url string, html string")
    out = {r.page_id: r for r in lang_id.page_rows(pages).collect()}
    assert (out[1].host, out[1].address, out[1].declared) == ("www.site.de", "de", None)
    assert (out[2].address, out[2].declared, out[2].text.split()) == ("fr", "en", ["hi", "you"])
    assert out[3].text is None
    assert [r.address for r in lang_id.page_rows(spark.createDataFrame([(1, "http://x.co.uk/a", "a"), (2, "http://x.mx", "a"), (3, "http://at/x", "a"), (4, "http://x.zz/de/", "a")], "page_id int, url string, html string")).orderBy("page_id").collect()] == ["en", "es", None, "de"]


def test_priors_broadcast_or_joined_are_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.fit(docs)
    plans = [lang_id.identify(docs, model, ["doc_id"], "source", priors_bytes=n) for n in (lang_id.PRIORS_BYTES, 8)]
    assert "BroadcastHashJoin" in plans[0]._jdf.queryExecution().toString()
    a, b = (sorted(map(tuple, p.collect())) for p in plans)
    assert a == b


def test_posteriors_by_brute_force(spark):
    """Priors smoothed from corpus to parent domain to host, and the product of all evidence, in plain Python."""
    rnd = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs)
    texts = [r.text for r in docs.where("length(text) < 60 or doc_id % 20 = 0").limit(120).collect()] + ["de", "la", "the", "123", "", None]
    hosts = ["a.site.org", "b.site.org", "x.other.net", "plain", None]
    rows = [(i, t, rnd.choice(hosts), rnd.choice([None, "fr", "EN-gb", "xx"]), rnd.choice([None, "de", "es"])) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "id int, text string, host string, declared string, address string").repartition(3)
    got = {r.id: r for r in lang_id.identify(df, model, ["id"], "host", "declared", "address").collect()}
    size, ll = len(model.languages), {}
    for i, t, *_ in rows:
        v, n = model.likelihood(t)
        ll[i] = v if n else None
    votes = [(h, int(ll[i].argmax())) for i, _, h, _, _ in rows if ll[i] is not None]
    base = np.ones(size)
    for _, v in votes:
        base[v] += 1
    base /= base.sum()
    above = lambda h: ".".join(h.split(".")[-2:]) if "." in h else None

    def counted(of):
        c = np.zeros(size)
        for h, v in votes:
            c[v] += h is not None and of(h)
        return c

    def prior(h):
        if h is None or not any(x == h for x, _ in votes):
            return base
        up = base
        if above(h):
            up = counted(lambda x: above(x) == above(h)) + base * lang_id.STRENGTH
            up /= up.sum()
        own = counted(lambda x: x == h) + up * lang_id.STRENGTH
        return own / own.sum()

    for i, _, h, declared, address in rows:
        r = got[i]
        if ll[i] is None:
            assert (r._sw_language, r._sw_probability, r._sw_rejected) == (None, 0, True)
            continue
        total = ll[i] + np.log(prior(h))
        for code, right in ((declared, lang_id.DECLARED), (address, lang_id.ADDRESS)):
            code = (code or "").lower().split("-")[0]
            if code in model.languages:
                total = total + np.log([right if x == code else (1 - right) / (size - 1) for x in model.languages])
        e = np.exp(total - total.max())
        assert abs(r._sw_probability - e.max() / e.sum()) < 1e-9
        assert r._sw_language == model.languages[int(total.argmax())] and r._sw_text_language == model.languages[int(ll[i].argmax())]
        assert r._sw_rejected == (r._sw_language == "und" or r._sw_probability < lang_id.LEAST)


def exact(rows, k, asked):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if asked(i):
            out[i] = sorted(((-float(np.cumsum(q * v)[-1]), j) for j, v in good if j != i))[:k]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(400)]
    hot = rnd.normal(size=8).tolist()
    rows += [(i, hot) for i in range(400, 560)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [None] * 8), (1060, [float("nan")] * 8), (1080, [1.0, float("inf")] + [0.0] * 6), (1100, [1.0]), (None, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit(1)).repartition(3)
    back = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact(back, 20, lambda i: i % 20 == 0)
    got: dict = {}
    for r in ann.neighbours(df, 20, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    assert got[400] == want[400]  # ties among equal vectors go to the smaller id
    few = ann.neighbours(df.where("vec_id < 5"), 20, F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.neighbours(df.where("false"), 20, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), 20, F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 300)
    monkeypatch.setattr(ann, "LEAST_CELL", 200)
    monkeypatch.setattr(ann, "LEAF", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rnd.normal(size=8) * 0.3).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20, lambda i: i % 20 == 0)
    got: dict = {}
    for r in ann.neighbours(df, 20, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[i] & {j for _, j in want[i]}) for i in want) / (20 * len(want)) >= 0.95


def test_chi_square():
    assert abs(ann.chi_square(0.95, 8) - 15.507) < 0.05 and abs(ann.chi_square(0.5, 8) - 7.344) < 0.05


def test_index_agrees_with_sorting():
    rnd = np.random.default_rng(1)
    x, q = rnd.normal(size=(700, 8)), rnd.normal(size=(30, 8))
    index = ann.Index(np.arange(700), x, float(np.sqrt((x * x).sum(1).max())))
    place, score = index.search(q, 10, np.full(30, -np.inf))
    right = 0
    for row in range(30):
        right += len(set(np.argsort(-(x @ q[row]))[:10]) & set(place[row]))
        assert (np.diff(score[row]) <= 0).all()
    assert right >= 0.95 * 300


def test_queries_have_the_columns_promised(spark):
    want = {
        "op1_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op4_wavelet_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op10_nearest": ["query_id", "rank", "vec_id", "score"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, DATA).columns[: len(columns)] == columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    rel = c.execute(queries.ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, rel.fetchall()))


def test_pipeline_by_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == columns and 0 < docs.count() <= held, name
        held = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(out) == held and all(r.decodes and r.n_tokens == len(r.ids) // 4 for r in out)
    run = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in run) == sorted((r.doc_id, bytes(r.ids)) for r in out)


def test_pipeline_of_nasty_documents(spark):
    import corpus_pipeline

    for docs in (nasty.documents(spark, n=10), nasty.empty(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA).persist()
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()


def test_random_hosts_are_reproducible(spark):
    rnd = random.Random(1)
    rows = [(i, nasty.prose(rnd, 20), "en", f"h{i % 3}.site.org") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    a, b = (lang_id.identify(df, lang_id.fit(df), ["doc_id"], "source").orderBy("doc_id").collect() for _ in range(2))
    assert a == b

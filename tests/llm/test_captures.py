"""WARC archives with their index, alignment of two tokenizers and centroid clustering: exact round trips and brute force."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import nasty
import numpy as np
import pytest
from sievewright.llm import align, centroids, warc

# -- archives

PAGES = "page_id long, url string, html string, address string, first long, sha1 string, line string, value string"


def pages(spark, n=150, seed=4):
    rnd = random.Random(seed)
    bodies = [None, "", "x", "é" * 900, nasty.prose(rnd, 4000), *(nasty.prose(rnd, rnd.randrange(1, 60)) for _ in range(30))]
    urls = [None, "", "http://a.example.com/x", "HTTPS://User@Blog.A.Example.com.:443/p?q=1#top", "http://a.example.com:8080", "http://127.0.0.1/z", "ftp://h/x y", "http://ü.de/\r\nWARC-Type: response", "no address", "http://b.example.com/" + "y" * 5000]
    rows = [(k - 3, rnd.choice(urls), rnd.choice(bodies), "clash", 7, "sha", "l", "v") for k in range(n)]
    rows += [rows[5], rows[5], (None, None, None, None, None, None, None, None), (None, "http://a.example.com/x", "x", None, None, None, None, None), (9, "http://other.example.com/", rows[12][2], None, None, None, None, None)]
    rows += [(10_000 + k, "http://hot.example.com/", "same", "c", 1, "s", "l", "v") for k in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, PAGES).repartition(3)


def expected(rows, least=0):
    first = {}
    for page, body in rows:
        if page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, body in rows:
        to = first.get(body)
        revisit = to is not None and to != page and len(body) >= least
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back_from_archives(spark):
    df = pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    assert sorted(map(tuple, warc.report(df).collect()), key=str) == expected(rows)
    assert warc.report(df.where("false")).count() == 0


def test_archives_are_gzip_members_of_whole_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 700)
    assert len(warc.members(b"x" * 1500)) == 3 and gzip.decompress(b"".join(m + b"\0" for m in warc.members(b"x" * 1500))) == b"x" * 1500
    archives = warc.write(pages(spark), least_bytes=100)
    kinds = Counter()
    for path in sorted(Path(archives.files.removeprefix("file:")).glob("part-*")):
        data = gzip.decompress(path.read_bytes())
        while data:
            end = data.index(b"\r\n\r\n") + 4
            size = end + int(data[:end].split(b"Content-Length: ")[1].split(b"\r\n")[0]) + 4
            headers, http, payload = warc.parsed(data[:size])
            kinds[headers["WARC-Type"]] += 1
            if headers["WARC-Type"] == "response":
                assert int(http["Content-Length"]) == len(payload)
            elif headers["WARC-Type"] == "revisit":
                assert not payload and int(http["Content-Length"]) >= 100
            data = data[size:]
    want = Counter(x[3] for x in expected([(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()], 100))
    assert kinds.pop("warcinfo") >= 1 and kinds == want


@pytest.mark.parametrize("lines", [1, 7, 2000])
def test_index_finds_ranges_of_keys(spark, lines):
    archives = warc.write(pages(spark))
    archives = warc.index(spark, archives.files, lines)
    every = sorted(r.line for r in warc.locate(archives, spark.createDataFrame([("", "\x7f")], "low string, high string")).collect())
    assert len(every) == 305 and [x for x, _ in archives.parts] == sorted(x for x, _ in archives.parts)
    asked = [warc.below("com,example,hot)"), warc.below("com,example,"), warc.below("zz"), ("com,example,a)/x ", "com,example,a)/x!"), ("urn:", "v"), (every[3], every[9]), (every[3], every[9]), (None, "x")]
    got = Counter(r.line for r in warc.locate(archives, spark.createDataFrame(asked, "low string, high string")).collect())
    want = Counter(x for low, high in {a for a in asked if a[0]} for x in every if low <= x < high)
    assert got == want and sum(x.startswith("com,example,hot)/ ") for x in every) == 150


def test_keys(spark):
    shown = {"http://www.Example.com/a?b#c": "com,example,www)/a?b", "https://u:p@h.org.:443": "org,h)/", "http://h.org:8080?x": "org,h:8080)/?x", "http://10.0.0.1/": "10.0.0.1)/", "urn:page:3": "urn:page:3", "http:///x": "http:///x"}
    df = spark.createDataFrame(list(shown), "string").toDF("u")
    assert {r.u: r.k for r in df.select("u", warc.capture_key(df.u).alias("k")).collect()} == shown
    df = spark.createDataFrame([(None,), (-(1 << 63),), (-5,), (0,), ((1 << 63) - 1,)], "n long")
    lines = [r[0] for r in df.orderBy("n").select(warc.capture_line(warc.F.lit("k"), warc.F.col("n"))).collect()]
    assert lines == sorted(lines) and len({len(x) for x in lines[1:]}) == 1


def test_damage_is_seen():
    record = warc.response(1, "http://a/", b"abc", "X", "2020-01-01T00:00:00Z")
    assert warc.parsed(record)[2] == b"abc"
    for bad in (record[:-1], record + b"x", b"", record.replace(b"WARC/1.1", b"WARC/0.9")):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)
    whole = b"".join(m + b"\0" for m in warc.members(b"abc"))
    with pytest.raises(ValueError):
        warc.unpacked(whole[:-3])


# -- alignment

ODD = ["a b  c\n\n d ", "  x", "don't  'tis", "", " ", "a ", "\n", "a\n b", " lead", "tab\tx y", "<|endoftext|> a <s> </s> <0x41>", "é à ü", "a\x1c b \x1d c", "x\xa0 y", "1 22 333", "漢字 仮名 ", "a" * 3000, "🙂 👍🏽 x", "﻿a b", "▁ a▁ b", "\x00 a", "é b", None]


def brute(sides, text):
    """Ids, groups and linked ids by byte places alone."""
    own = " " + (text or "")
    a, b = sides.a.encode(own, add_special_tokens=False).ids, sides.b.encode(text or "")
    left, right = [sides.spelt[0][x] for x in a], [sides.spelt[1][x] for x in b]
    if not text or b"".join(left) != own.encode() or b"".join(right) != own.encode():
        return [], [], ""
    ends, others = np.cumsum(list(map(len, left))).tolist(), np.cumsum(list(map(len, right))).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends) & set(others)):
        k, m = ends.index(cut, i) + 1, others.index(cut, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    links, j = [], 0
    for x, end in enumerate(ends):
        while others[j] <= end - len(left[x]):
            j += 1
        links += [(a[x], b[y]) for y in range(j, len(b)) if others[y] - len(right[y]) < end and y < j + 4000]
    return a, groups, (b, links)


@pytest.fixture(scope="module")
def sides():
    return align.Sides()


def test_transducer_on_small_vocabularies():
    rnd = random.Random(8)
    for _ in range(200):
        words = [bytes(rnd.choices(b"ab", k=rnd.randrange(1, 5))) for _ in range(8)]
        t = align.Transducer(words, [b"a", b"b", b"ab", b"ba", b"aab"])
        a = rnd.choices(range(8), k=rnd.randrange(0, 9))
        spelt, b = b"".join(words[x] for x in a), []
        while len(b"".join(t.right[x] for x in b)) < len(spelt):
            rest = spelt[len(b"".join(t.right[x] for x in b)) :]
            b.append(rnd.choice([k for k, w in enumerate(t.right) if rest.startswith(w)]))
        groups, links = t.align(a, b)
        ends = [np.cumsum([len(v[x]) for x in s]).tolist() for v, s in ((words, a), (t.right, b))]
        assert groups == [(ends[0].index(x) + 1, ends[1].index(x) + 1) for x in sorted(set(ends[0]) & set(ends[1]))]
        assert len(links) == len(a) + len(b) - len(groups)
        with pytest.raises(ValueError):
            t.align([*a, 0], b)
        with pytest.raises(ValueError):
            t.align(a, [*b, 0])
    t.KEPT = 3
    assert t.align(a, b) == (groups, links) == t.align(a, b)


def test_alignment_by_brute_force(spark, sides):
    rnd = random.Random(5)
    docs = [(None if k == 3 else k // 2, t) for k, t in enumerate([*ODD, *("".join(rnd.choices([x for x in ODD if x], k=8)) for _ in range(20))])]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(nasty.documents(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = {text: brute(sides, text) for _, text in rows}
    count = Counter(pair for _, text in rows if found[text][1] for pair in set(found[text][2][1]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = []
    for doc, text in rows:
        a, groups, more = found[text]
        links = more[1] if groups else []
        want.append((doc, len(a), len(more[0]) if groups else 0, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    assert sum(not x[1] for x in want) > 3
    extra = df.withColumns({"rid": warc.F.lit(1), "pairs": warc.F.lit("x"), "n": warc.F.lit(2)})
    for head in (align.HEAD, 300, 0):
        assert sorted(map(tuple, align.score(extra, head=head).collect()), key=str) == sorted(want, key=str), head
    assert align.score(df.where("false")).count() == 0
    shown = {(r.doc_id, ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups or [])) for r in align.alignments(df).collect()}
    assert shown == {(doc, ";".join(found[text][1])) for doc, text in rows}


def test_pairs_are_packed(sides):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    for pairs in ([], [5], [0, 1, 2**32, 2**32 + 7, (50256 << 32) + 31999]):
        times = np.arange(len(pairs)) + 1
        back, n = align.unpacked(align.packed(np.array(pairs, "<u8"), times, pack))
        assert back.tolist() == pairs and n.tolist() == times.tolist()


def test_cuts_are_forgotten(sides, monkeypatch):
    rnd = random.Random(2)
    texts = [nasty.prose(rnd, 60) for _ in range(30)]
    want = [[(c.n_a, c.n_b, c.text) for c in x] for x in sides.documents(texts)]
    monkeypatch.setattr(align, "CUTS", 5)
    small = align.Sides()
    for _ in range(2):
        assert [[(c.n_a, c.n_b, c.text) for x in [t] for c in small.documents([x])[0]] for t in texts] == want


# -- clustering


def whole(q, start, rounds):
    """Exact clustering with all distances, in Python integers."""
    c = [list(x) for x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c))

    for _ in range(rounds):
        of = defaultdict(list)
        for x in q:
            of[nearest(x)[1]].append(x)
        c = [[sum(v) // len(of[k]) for v in zip(*of[k], strict=True)] if k in of else c[k] for k in range(len(c))]
    return [nearest(x) for x in q], c


@pytest.mark.parametrize(("spread", "k"), [(1.0, 16), (0.0, 5), (40.0, 3)])
def test_clusters_by_brute_force(spark, spread, k):
    rnd = random.Random(k)
    hubs = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    vectors = [[h + rnd.gauss(0, 0.3) * spread for h in rnd.choice(hubs)] for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (3, vectors[4]), (None, vectors[5]), (700, None), (701, [1.0] * 63), (702, [1.0] * 65), (703, [None, *[1.0] * 63]), (704, [float("nan")] * 64), (705, [float("inf"), *[0.0] * 63]), (706, [])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, q string").repartition(3)
    q = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = [v for _, v in sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes()), v) for i, v in q if i is not None)][:k]
    near, c = whole([v for _, v in q], start, 3)
    sums = Counter()
    for d, j in near:
        sums[j] += d
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    want = [(i, j, d, sums[j], sum(sums.values()), name[j]) for (i, _), (d, j) in zip(q, near, strict=True)]
    assert sorted(map(tuple, centroids.report(df, k=k).collect()), key=str) == sorted(want, key=str)
    assert centroids.report(df.where("vec_id is null"), k=k).count() == centroids.report(df.where("false")).count() == 0


def test_screen_rules_out_most_and_nothing_wrongly():
    rnd = np.random.default_rng(1)
    for big in (1, 50, 3000, centroids.LARGEST):
        q, c = (np.round(rnd.uniform(-big, big, (n, 64))).astype(np.int64) for n in (500, 40))
        c[7] = c[3]  # a tie
        d = ((q[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        own, theirs = centroids.screen(q), centroids.screen(c)
        assert (own.bounds(theirs) <= d.astype(np.float64) * (1 + 1e-12)).all()
        who, best, taken = centroids.nearest(q, own, c, theirs)
        assert who.tolist() == [int(np.argmin(x)) for x in d] and best.tolist() == [int(x.min()) for x in d]
        assert taken < 0.2 * d.size or big == 1


def test_numbers_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()

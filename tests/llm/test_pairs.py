"""Near-dedup, passage dedup and decontamination against brute force."""

import random
from itertools import combinations

import nasty
import numpy as np
import pytest
from sievewright.llm import decontaminate, near_dedup, passage_dedup
from sievewright.llm.common import WordIds, alnum_words, components, forest, space_words


def brute_components(rows, width=2, percent=80):
    sets = []
    for i, t in rows:
        w = space_words((t or "").encode())
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [(i, len(sets[k]), best.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    docs = nasty.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=width).collect()), key=repr)
    assert got == sorted(brute_components(rows, width), key=repr)
    assert near_dedup.near_duplicates(nasty.empty(spark)).count() == 0


def test_near_copies_around_the_threshold(spark):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(8, 160))]
        for _ in range(8):
            copy = [rnd.choice(words) if rnd.random() < rnd.choice([0.01, 0.04, 0.07]) else w for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "KEY_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 4)
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: rnd.randrange(50, 60)] + [f"own{k}"] * (k % 3))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))


def test_signature_distance_guarantee():
    """Every pair of signatures within DISTANCE shares a chunk with at most ERRORS errors, so a key."""
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = rnd.integers(0, 1 << 16, near_dedup.SLOTS)
        b = a.copy()
        b[rnd.choice(near_dedup.SLOTS, near_dedup.DISTANCE, replace=False)] += 1
        chunks = (a != b).reshape(near_dedup.CHUNKS, near_dedup.WIDTH).sum(1)
        assert chunks.min() <= near_dedup.ERRORS


def test_one_of_each(spark):
    docs = nasty.documents(spark)
    kept = near_dedup.one_of_each(docs, width=2)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 2
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if i is not None and (i == c or c is None)}
    assert set(ids) == want | {r.doc_id for r in docs.collect() if r.doc_id is not None and not (r.text or "").split()}
    assert near_dedup.one_of_each(nasty.empty(spark)).count() == 0


def test_one_of_each_where_doc_ids_repeat(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))

    def kept(rows):
        return sorted((r.doc_id, r.text) for r in near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    assert kept([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert len(kept([(5, a), (5, a + " tail")])) == 1
    assert kept([(7, a), (7, a), (8, b), (8, b)]) == [(7, a), (8, b)]


def test_joins_of_frequent_keys(spark, monkeypatch):
    """Dealt out, a frequent key's rows meet the same rows as in a plain join."""
    from sievewright.llm import common

    monkeypatch.setattr(common, "HOT", 20)
    left = spark.createDataFrame([(None if k % 50 == 0 else k % 7 if k % 2 else 0, k) for k in range(1000)], "g long, x long")
    right = spark.createDataFrame([(g, -g, g * 2) for g in range(6)] + [(0, 5, 5), (None, 1, 1)], "g long, y long, z long")
    for how in ("inner", "left"):
        plain = left.join(right, ["g"], how)
        got = common.salted(left, right, ["g"], how)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (11, 12), (12, 10), *((100 + k, 101 + k) for k in range(40))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{k: 100 for k in range(100, 141)}}
    assert components(df.where("false")).count() == 0


def test_forest_joins_what_is_linked():
    rnd = np.random.default_rng(4)
    link = rnd.random((30, 30)) < 0.05
    link |= link.T
    labels = np.arange(30)
    pairs = forest(lambda i: np.flatnonzero(link[i]), labels)
    assert len(pairs) == 30 - len(set(labels.tolist())) and all(link[a, b] for a, b in pairs)
    assert all(labels[a] == labels[b] for a, b in zip(*np.nonzero(link)))


@pytest.mark.parametrize("n", [2, 6, 9, 40])
def test_intersections(n):
    rnd = np.random.default_rng(n)
    sets = [np.unique(rnd.integers(0, 50, rnd.integers(1, 40))).astype(np.uint64) for _ in range(n)]
    got = near_dedup.intersections(sets)
    for a, b in combinations(range(n), 2):
        assert got[a, b] == got[b, a] == len(set(sets[a].tolist()) & set(sets[b].tolist()))


def test_chains_keep_order():
    x, y = np.array([0, 10, 20, 20, 30, 40]), np.array([100, 110, 5, 120, 130, 6])
    best = passage_dedup.chain(x, y)
    assert best[0].tolist() == [0, 1, 3, 4] and sorted(np.concatenate(best).tolist()) == list(range(6))
    for links in best:
        assert (np.diff(x[links]) > 0).all() and (np.diff(y[links]) > 0).all()


def test_chain_scores_by_brute_force():
    rnd = np.random.default_rng(9)
    for _ in range(30):
        n = int(rnd.integers(2, 25))
        pts = sorted({(int(a), int(b)) for a, b in rnd.integers(0, 60, (n, 2))})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        f = []
        for i in range(len(pts)):
            gains = [f[j] - passage_dedup.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            f.append(passage_dedup.K + max([0, *gains]))
        links = passage_dedup.chain(x, y)[0]
        score = sum(passage_dedup.K for _ in links) - passage_dedup.GAP_COST * (np.diff(x[links]).sum() + np.diff(y[links]).sum())
        assert abs(score - max(f)) < 1e-9


def test_planted_passages(spark):
    rnd = random.Random(8)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(50000)}" for _ in range(n)]
    long, edited = fresh(55), fresh(80)
    changed = [w if k % 17 else "zz" for k, w in enumerate(edited)]
    short = fresh(30)
    texts = [fresh(200) + long + fresh(100), fresh(40) + long + fresh(300), fresh(20) + edited + fresh(20), changed + fresh(90), fresh(90) + short, short + fresh(200), fresh(400), long[:20] + fresh(100), fresh(60) + long]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.ref_doc_id): (r.start, r.end) for r in passage_dedup.passages(docs).collect()}
    assert got[(1, 0)] == (40, 95) and got[(8, 0)] == (60, 115)
    assert set(got) == {(1, 0), (3, 2), (8, 0)}
    start, end = got[(3, 2)]
    assert start <= 1 and 79 <= end <= 80
    left = {r.doc_id: (r.text or "").split() for r in passage_dedup.clean(docs).collect()}
    assert left[1] == texts[1][:40] + texts[1][95:] and left[0] == texts[0] and left[5] == texts[5] and left[8] == texts[8][:60]


def test_passages_whose_parts_stand_earlier(spark):
    rnd = random.Random(21)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(50000)}" for _ in range(n)]
    texts, want = [], {}
    for _ in range(40):
        whole = fresh(90)
        for s in (0, 30, 60):
            texts.append(fresh(60) + whole[s : s + 30] + fresh(60))
        # One edit beside each junction, so that no ungapped run leads over it.
        edited = [*whole[:32], "extra", *whole[32:61], *whole[62:]]
        texts += [fresh(40) + whole + fresh(40), fresh(50) + edited + fresh(50)]
        want[len(texts) - 1] = len(texts) - 2
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.ref_doc_id): r for r in passage_dedup.passages(docs).collect()}
    assert set(got) == set(want.items())
    assert all(r.start <= 52 and r.end >= 138 and r.matched >= 86 for r in got.values())


@pytest.mark.parametrize(("size", "every"), [(60, 10), (80, 8), (100, 7)])
@pytest.mark.parametrize("kind", ["insert", "delete", "both", "replace"])
def test_passages_with_edits(spark, size, every, kind):
    rnd = random.Random(size)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(50000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        whole = fresh(size)
        edited = []
        for k, w in enumerate(whole):
            hit = k % every == every - 1
            turn = k // every % 2
            if hit and (kind == "replace" or kind == "both" and turn):
                edited.append("other")
            elif not hit or kind == "insert":
                edited += [w, "extra"] if hit else [w]
            elif kind == "both":
                edited += [w, "extra"]
        texts += [fresh(60) + whole + fresh(60), fresh(30) + edited + fresh(90)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in passage_dedup.passages(docs).collect()}
    assert len(got) >= 38


def fresh_words(rnd, n):
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(50000)}" for _ in range(n)]


def test_fragments_of_a_passage_do_not_hide_it(spark):
    """Many earlier documents hold a part of a passage, which two later ones hold whole."""
    rnd = random.Random(31)
    whole = fresh_words(rnd, 300)
    few = [fresh_words(rnd, 40) + whole[s : s + 30] + fresh_words(rnd, 60) for s in range(0, 290, 24)]
    many = [fresh_words(rnd, 40) + whole[s : s + 30] + fresh_words(rnd, 60) for _ in range(30) for s in range(0, 271, 15)]
    for parts in (few, many):
        texts = [*parts, fresh_words(rnd, 90) + whole + fresh_words(rnd, 20), fresh_words(rnd, 70) + whole + fresh_words(rnd, 50)]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = [tuple(r) for r in passage_dedup.passages(docs).collect()]
        last = len(texts) - 1
        assert got == [(last, 70, 370, last - 1, 90, 390, 300)]
        left = {r.doc_id: r.text.split() for r in passage_dedup.clean(docs).collect()}
        assert left[last] == texts[last][:70] + texts[last][370:] and left[last - 1] == texts[last - 1]


def corpus_with_repeats(rnd, n):
    """Texts as word lists that share runs, sentences in other order, copies, near copies and frequent lines."""
    lines = [fresh_words(rnd, rnd.randrange(6, 30)) for _ in range(12)]
    runs = [fresh_words(rnd, rnd.randrange(40, 200)) for _ in range(25)]
    texts = []
    for _ in range(n):
        words = fresh_words(rnd, rnd.randrange(0, 80))
        for _ in range(rnd.randrange(1, 5)):
            run = rnd.choice(runs)
            a = rnd.randrange(0, len(run) // 2)
            words += rnd.choice([run, run, run[a:], run[:-a or None], rnd.choice(lines), rnd.choice(lines)]) + fresh_words(rnd, rnd.randrange(0, 40))
        if texts and rnd.random() < 0.15:
            words = list(rnd.choice(texts))
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = "changed"
        texts.append(words)
    return texts


@pytest.mark.parametrize("pairs", [2, 16])
def test_words_of_repeated_runs_by_brute_force(spark, monkeypatch, pairs):
    """Of all words in runs of 50 that an earlier document has, 98 % are in passages; passages hold what they claim."""
    monkeypatch.setattr(passage_dedup, "PAIRS", pairs)
    rnd = random.Random(77)
    texts = corpus_with_repeats(rnd, 300)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = passage_dedup.passages(docs).collect()
    inside = [set() for _ in texts]
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.ref_doc_id][r.ref_start : r.ref_end]
        assert r.ref_doc_id < r.doc_id and r.matched >= 50 and r.matched >= 0.8 * max(len(a), len(b))
        row = [0] * (len(b) + 1)
        for w in a:
            up = row[:]
            for j, v in enumerate(b):
                row[j + 1] = up[j] + 1 if v == w else max(up[j + 1], row[j])
        assert row[-1] >= r.matched
        inside[r.doc_id].update(range(r.start, r.end))
    seen, wanted, found = set(), 0, 0
    for k, words in enumerate(texts):
        windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        repeated = {i + j for i, w in enumerate(windows) if w in seen for j in range(50)}
        seen.update(windows)
        wanted += len(repeated)
        found += len(repeated & inside[k])
    assert wanted > 10_000 and found >= 0.98 * wanted


def test_recall_of_fuzzy_passages(spark):
    """Passages with a tenth or a fifth of their words edited at random, by brute force over planted pairs."""
    for rate, least in ((0.1, 0.97), (0.18, 0.9)):
        rnd = random.Random(int(rate * 100))
        texts, want = [], 0
        for _ in range(120):
            whole = fresh_words(rnd, 90)
            edited = []
            for w in whole:
                kind = rnd.choice(["insert", "delete", "replace"]) if rnd.random() < rate else "keep"
                edited += {"insert": [w, "extra"], "delete": [], "replace": ["other"], "keep": [w]}[kind]
            texts += [fresh_words(rnd, 60) + whole + fresh_words(rnd, 60), fresh_words(rnd, 30) + edited + fresh_words(rnd, 90)]
            want += 1
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id for r in passage_dedup.passages(docs).collect()}
        assert len(got) >= least * want and all(k % 2 for k in got)


def test_pairs_of_classes():
    """Small groups are joined whole; of large ones each class with the first of every part that it is in."""
    rnd = np.random.default_rng(6)
    for n in (2, 5, 16, 17, 60):
        doc, at = rnd.permutation(1000)[:n].astype(np.int64), rnd.integers(0, 90, n).astype(np.int32)
        ahead = np.sort(sum(rnd.integers(0, 3, n).astype(np.uint64) << np.uint64(16 * k) for k in range(4)))
        a, b = passage_dedup.joined(ahead, doc, at, np.array([0, n]))
        got = set(zip(doc[a].tolist(), doc[b].tolist(), strict=True))
        assert all(x > y for x, y in got)
        if n <= passage_dedup.PAIRS:
            assert len(got) == n * (n - 1) // 2
        else:
            assert {(d, doc.min()) for d in doc.tolist() if d != doc.min()} <= got
            for shift in (48, 32, 16, 0):
                part = ahead >> np.uint64(shift)
                for p in set(part.tolist()):
                    group = doc[part == p]
                    assert {(d, group.min()) for d in group.tolist() if d != group.min()} <= got


def test_a_seed_that_fills_the_rows(spark, monkeypatch):
    """A frequent line beside a passage: blocks of rows are smaller than the seed's occurrences."""
    monkeypatch.setattr(passage_dedup, "ROWS", 300)
    rnd = random.Random(12)
    line, whole = fresh_words(rnd, 30), fresh_words(rnd, 80)
    texts = [fresh_words(rnd, 30) + line + fresh_words(rnd, 40) for _ in range(1500)]
    for k in (200, 700, 1400):
        texts[k] = fresh_words(rnd, 30) + line + whole
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.ref_doc_id, r.start, r.end) for r in passage_dedup.passages(docs).collect()}
    assert got == {(700, 200, 30, 140), (1400, 200, 30, 140)}


@pytest.mark.parametrize("rows", [200_000, 300])
def test_equal_runs_beside_many_fragments_are_all_found(spark, monkeypatch, rows):
    """Of passages of 50 words and more beside many earlier fragments every one is found, and of all words in runs of 50 that an earlier document has every one is in a passage."""
    monkeypatch.setattr(passage_dedup, "ROWS", rows)
    rnd = random.Random(5)
    texts, last, planted = [], [], []
    for size in (50, 51, 54, 58, 58, 58, 58, 64, 64, 64, 70, 80):
        whole = fresh_words(rnd, size)
        for _ in range(40):
            n = rnd.randrange(45, 49)
            a = rnd.randrange(size - n + 1)
            texts.append(fresh_words(rnd, rnd.randrange(30)) + whole[a : a + n] + fresh_words(rnd, rnd.randrange(5, 30)))
        last += [fresh_words(rnd, 60) + whole + fresh_words(rnd, 20), fresh_words(rnd, 10) + whole + fresh_words(rnd, 60)]
    rnd.shuffle(texts)
    planted = list(range(len(texts) + 1, len(texts) + len(last), 2))
    texts += last + corpus_with_repeats(rnd, 200)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    inside = [set() for _ in texts]
    for r in passage_dedup.passages(docs).collect():
        assert r.ref_doc_id < r.doc_id
        inside[r.doc_id].update(range(r.start, r.end))
    seen, lost = set(), 0
    for k, words in enumerate(texts):
        runs = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        lost += len({i + j for i, w in enumerate(runs) if w in seen for j in range(50)} - inside[k])
        seen.update(runs)
    assert lost == 0 and all(inside[k] for k in planted)


def test_repeated_doc_ids_have_the_least_text(spark):
    rnd = random.Random(14)
    whole = fresh_words(rnd, 70)
    texts = [(1, ["zz", *whole]), (1, ["aa", *fresh_words(rnd, 60)]), (2, ["b", *whole]), (3, ["c", *whole]), (3, ["c", *whole]), (4, [*whole, "d"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert {(r.doc_id, r.ref_doc_id) for r in passage_dedup.passages(docs).collect()} == {(3, 2), (4, 2)}
    left = sorted((r.doc_id, r.text) for r in passage_dedup.clean(docs).collect())
    assert left == sorted([*((i, " ".join(t)) for i, t in texts[:3]), (3, "c "), (3, "c "), (4, " d")])
    with pytest.raises(ValueError):
        passage_dedup.passages(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_passages_of_nasty_documents(spark):
    docs = nasty.documents(spark)
    for r in passage_dedup.passages(docs).collect():
        assert r.ref_doc_id < r.doc_id and 0 <= r.start < r.end
    cleaned = passage_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    rows = cleaned.collect()
    assert sum(r.text is None for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert passage_dedup.passages(nasty.empty(spark)).count() == 0 and passage_dedup.clean(nasty.empty(spark)).count() == 0


def brute_hits(words, items, window=10):
    hit, who = set(), set()
    for name, seq in items:
        n = min(window, len(seq))
        windows = {tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                who.add(name)
    return hit, who


def test_automaton_by_brute_force():
    rnd = random.Random(4)
    for trial in range(60):
        few = [b"a", b"b", b"c", b"d"][: rnd.choice([2, 3, 4])]
        items = [(str(k), [rnd.choice(few) for _ in range(rnd.randrange(0, 25))]) for k in range(rnd.randrange(1, 9))]
        window = rnd.choice([1, 3, 10])
        model = decontaminate.Automaton(items, window)
        for _ in range(10):
            words = [rnd.choice([*few, b"z"]) for _ in range(rnd.randrange(0, 60))]
            spans, who = model.scan(words)
            assert ({k for a, b in spans for k in range(a, b)}, who) == brute_hits(words, items, window), trial


def test_report_and_clean(spark, monkeypatch):
    docs = nasty.documents(spark)
    base = docs.where("doc_id = 10").first().text
    part = " ".join(base.split()[5:30])
    bench = spark.createDataFrame([(1, part), (2, "never seen words at all"), (3, None), (4, ""), (5, "one"), (1, "gnu general public"), (None, "Lamp moon tide")], "item_id long, text string")
    items = [("null" if r.item_id is None else str(r.item_id), alnum_words((r.text or "").encode())) for r in bench.collect()]
    rows = docs.collect()
    want = {}
    for r in rows:
        words = alnum_words((r.text or "").encode())
        want[r.text] = (len(words), *brute_hits(words, items))

    def check():
        got = decontaminate.find(docs.drop("_sw_hits"), bench, keep_text=True).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, who = want[r.text]
            assert r._sw_n_words == n and {k for h in r._sw_hits for k in range(h.start, h.end)} == hit and r._sw_items == sorted(who)

    check()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    monkeypatch.setattr(decontaminate, "GROUP", 2)
    check()
    monkeypatch.setattr(decontaminate, "HELD", 2000)
    check()
    with pytest.raises(ValueError):
        decontaminate.find(docs, bench)
    out = decontaminate.clean(docs, bench, max_coverage=0.3)
    assert out.columns == docs.columns
    assert {r.text for r in rows if not want[r.text][1]} <= {r.text for r in out.collect()}
    assert decontaminate.report(nasty.empty(spark), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_clean_cuts_the_passage_alone(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, "Keep this. Alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda! And this stays too, all of it, as it was written before."), (2, item), (3, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert got == {1: "Keep this. ! And this stays too, all of it, as it was written before.", 3: "clean words"}


def test_word_ids_forget_but_agree():
    ids = WordIds()
    ids.LIMIT = 3
    words = [b"a", b"b", b"c", b"d", b"a"]
    assert ids.of(words).tolist() == WordIds().of(words).tolist()

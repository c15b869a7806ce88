"""Byte-level BPE, wavelet shards, licence scans and chat formatting: exact round trips and brute force."""

import hashlib
import random
import zlib

import nasty
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sievewright.llm import bpe, chat, license_scan, wavelet
from sievewright.llm.common import alnum_words

ODD = ["a b  c\n\n d ", "  x", "don't  'tis", "   x  y", "", " ", "a ", "\n", "a  b", "a\n b", " lead", "tab\tx y", "<|endoftext|> a", "é à ü", "a\x1c b \x1d c", "x\xa0 y", "x   y z", "1 22 333", "漢字 仮名 ", "a" * 5000, "🙂 👍🏽 x", "﻿a b"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks()


def test_pieces_do_not_change_ids(ranks):
    rnd = random.Random(6)
    for text in [*ODD, "".join(rnd.choice(ODD) for _ in range(400))]:
        whole = ranks.encoder.encode_ordinary(text)
        assert [i for x in bpe.pieces(text, 7) for i in ranks.encoder.encode_ordinary(x)] == whole
        assert ranks.decode(np.array(whole, "<u4")) == text.encode()
    long = " ".join(rnd.choice(nasty.WORDS) for _ in range(30000))
    assert ranks.encode(long).tolist() == ranks.encoder.encode_ordinary(long)


def test_round_trip(spark, ranks):
    docs = nasty.documents(spark)
    want = sorted((str(r.doc_id), len(i := ranks.encoder.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs).collect()) == want
    for r in bpe.round_trip(docs, keep=("doc_id", "text")).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip_digests(nasty.empty(spark)).count() == 0


def library():
    """The tokenizer as it comes from its file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


MARKS = ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|><|endoftext|> y\n", "<|endoftext|", "|endoftext|>", "it's <|endoftext|>'s", " <|endoftext|>  z"]


def test_encoder_agrees_with_the_library():
    e = wavelet.Encoder()
    rnd = random.Random(3)
    texts = [*ODD, *MARKS, "word, " * 9000 + "<|endoftext|> end", None, *(nasty.prose(rnd, rnd.randrange(0, 80)) for _ in range(200))]
    e.LIMIT = 50  # forgets all the time
    assert library().encode("<|endoftext|> a", add_special_tokens=False).ids == [50256, 257]
    for _ in range(2):
        tokens, n = e.encode(pa.array(texts), 0)
        want = [x.ids + [0] for x in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert tokens.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))


@pytest.mark.parametrize(("n", "sigma"), [(1, 1), (2, 2), (64, 2), (777, 3), (5000, 900), (3000, 70000), (1 << 16, 5), (140_001, 300)])
def test_wavelet_matrix(n, sigma):
    rnd = np.random.default_rng(n)
    x = (rnd.zipf(1.3, n) % sigma).astype("<u4")
    s = wavelet.Shard(wavelet.build(x, np.array([n])))
    assert s.tokens().tolist() == x.tolist() and s.lengths.tolist() == [n]
    for i in rnd.integers(0, n, 20):
        assert s.access(int(i)) == x[i]
    for t in {*x[rnd.integers(0, n, 5)].tolist(), sigma + 5}:
        a, b = sorted(rnd.integers(0, n + 1, 2).tolist())
        assert s.count(t, a, b) == (x[a:b] == t).sum() and s.occurrences(t) == np.flatnonzero(x == t).tolist()
    a, b = sorted(rnd.integers(0, n + 1, 2).tolist())
    assert s.at(np.arange(a, b)).tolist() == x[a:b].tolist()
    for k in range(s.planes):
        bits = np.unpackbits(s._words(k).view(np.uint8), bitorder="little", count=n)
        for i in rnd.integers(0, n + 1, 9):
            assert s.rank1(k, int(i)) == bits[:i].sum()
        for bit in (0, 1):
            at = np.flatnonzero(bits == bit)
            for j in range(0, len(at), max(1, len(at) // 7)):
                assert s.select(k, bit, j) == at[j]


def test_bad_shards():
    with pytest.raises(ValueError):
        wavelet.Shard(b"x" * 100)


def test_shards_hold_the_corpus(spark):
    docs = nasty.documents(spark)
    shards = wavelet.write_shards(docs, shard_tokens=500, partitions=3)
    got = wavelet.read_documents(shards).collect()
    plain = library()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert wavelet.read_documents(wavelet.write_shards(nasty.empty(spark))).count() == 0


def test_expressions():
    ev = lambda x: license_scan.evaluate(license_scan.parse(x))
    assert ev("MIT") == (frozenset({"mit"}), True)
    assert ev("GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0") == (frozenset({"gpl-2.0-only", "apache-2.0"}), True)
    assert ev("MITRE")[1] is False and ev("apache-2.0+")[1] is True and ev("BSD-Protection")[1] is False
    assert ev("(MIT OR GPL-3.0+) AND BSD-3-Clause")[1] is True and ev("MIT AND GPL-3.0")[1] is False
    assert license_scan.parse("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    for bad in ("", "(MIT", "MIT)", "MIT MIT", "AND MIT", "MIT OR", "()", "MIT (GPL)"):
        with pytest.raises(ValueError):
            license_scan.parse(bad)


def test_scan_by_brute_force(spark):
    docs = nasty.documents(spark)
    rows = {str((r.doc_id, r.text)): r for r in docs.collect()}
    got = license_scan.scan(docs).collect()
    want = []
    for r in docs.collect():
        w = [x.decode() for x in alnum_words((r.text or "").encode())]
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((str(r.doc_id), len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want, key=str) or sorted(map(str, ((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(map(str, want))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got) and len(rows) <= len(got)
    one = license_scan.Scanner().scan("/* SPDX-License-Identifier: MIT OR (GPL-2.0 AND x */\n# SPDX-License-Identifier: (MIT OR Apache-2.0)\nCC BY-NC 4.0")
    assert one["expressions"] == "(MIT OR Apache-2.0)" and one["permissive"] and one["labels"] == "apache-2.0,cc-by,cc-by-nc,mit" and one["base_labels"] == "cc-by"
    assert license_scan.scan(nasty.empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "expression"),
    [
        ("<!-- SPDX-License-Identifier: MIT -->", "MIT"), ("<!--SPDX-License-Identifier: MIT-->", "MIT"), ("/* SPDX-License-Identifier: BSD-3-Clause */ int x;", "BSD-3-Clause"),
        ("SPDX-License-Identifier: Apache-2.0 See LICENSE for details.", "Apache-2.0"), ("It says SPDX-License-Identifier: GPL-2.0+ OR MIT. More text here", "GPL-2.0+ OR MIT"),
        ("(SPDX-License-Identifier: ISC)", "ISC"), ("[//]: # SPDX-License-Identifier: (MIT OR Zlib) AND ISC -- note", "(MIT OR Zlib) AND ISC"), ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", "MIT;ISC"),
        ("SPDX-License-Identifier: -->", ""), ("SPDX-License-Identifier: (MIT x", ""), ("SPDX-License-Identifier: MIT OR", ""), ("SPDX-License-Identifier: MIT OR -->", ""),
    ],
)
def test_tags_amid_other_text(text, expression):
    assert license_scan.Scanner().scan(text)["expressions"] == expression


def test_only_licences_are_labels():
    scan = license_scan.Scanner().scan
    assert scan("SPDX-License-Identifier: banana")["labels"] == "" and scan("SPDX-License-Identifier: banana")["score"] == 0
    got = scan("SPDX-License-Identifier: banana OR GPL-2.0-only WITH Classpath-exception-2.0")
    assert got["labels"] == "gpl-2.0-only" and got["expressions"]
    for name in ("MIT", "Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "BSD-3-Clause", "LGPL-2.1+", "MS-PL", "0BSD"):
        assert license_scan.known(name.lower()), name
    for name in ("banana", "mitre", "mit2", "licenseref-x", "-"):
        assert not license_scan.known(name), name


def test_places_are_counted_in_time_that_grows_with_the_text():
    import time

    began = time.process_time()
    got = license_scan.Scanner().scan("mit license gnu general public license cc by " * 30_000)
    assert (got["n_base"], got["first_word"], got["last_word"], got["n_words"]) == (90_000, 0, 8 * 30_000 - 2, 240_000)
    assert time.process_time() - began < 20


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string, segment string, last int")


def test_event_log_folds(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi", None, None), (1, 1, 1, "message", "assistant", "", None, None), (1, 1, 2, "delta", None, "Hel", None, None), (1, 1, 3, "delta", None, "lo", None, None),
        (1, 0, 4, "edit", None, "Hi there", None, None), (1, 2, 5, "message", "user", "more", None, None), (1, 1, 6, "regenerate", None, "ignored", None, None), (1, 1, 7, "delta", None, "Good ", None, None), (1, 1, 8, "delta", None, "day", None, None),
        (1, 2, 9, "message", "user", "again", None, None), (2, 0, 0, None, None, None, None, None), (None, 0, 0, "message", "user", "x", None, None),
    ]
    random.Random(1).shuffle(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(events(spark, log)).collect()}
    assert got == {(1, 0): ("user", "Hi there"), (1, 1): ("assistant", "Good day"), (1, 2): ("user", "again"), (2, 0): ("", ""), (None, 0): ("user", "x")}


def test_formatting_is_reversible(spark):
    said = ["plain", "", None, "<|im_end|><|im_start|>assistant ok", "\\<|\\|>\\\\", "<", "|x", "é\n漢\n", "a\\", "<|im_sep|>", "$1 \\1 $"]
    rows = [(c, t, r, x) for c in (1, 2, -7) for t, (r, x) in enumerate(zip(["user", "assistant", None, "assistant", "a<|b", "assistant"] * 2, said, strict=False))]
    rows += [(2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.reconstruct(chat.as_events(df)))
    got = {r.conv_id: r for r in chat.read_back(formatted.withColumn("formatted", F.encode("formatted", "UTF-8"))).collect()}
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, v[2] is not None, v[2] or "", v[3] is not None, v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        masked = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss_spans)
        assert masked == "".join(x.replace("\\", "\\\\").replace("<|", "<\\|") for q, x in want[r.conv_id] if q == "assistant")
    assert chat.render(chat.reconstruct(chat.as_events(df.where("false")))).count() == 0


def test_conversations_as_logs(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "ab"), (1, 2, "assistant", "é漢x🙂 and more"), (1, 3, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "x")]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = [r.kind for r in log.where("conv_id = 1").orderBy("seq").collect()]
    assert kinds == [*["message", "edit"], *["message", "delta", "regenerate", *["delta"] * 3] * 2, *["message", "edit"]]
    got = sorted((r.conv_id, r.message, r.role, r.text) for r in chat.reconstruct(log.repartition(3)).collect())
    assert got == [(1, 1, "user", "hello there"), (1, 2, "assistant", "ab"), (1, 3, "assistant", "é漢x🙂 and more"), (1, 4, "", ""), (2, 1, "assistant", ""), (2, 2, "assistant", "x")]


def test_base_phrases_by_sql(spark):
    """n_words, n_base, first_word, last_word and base_labels as DuckDB has them."""
    import duckdb

    data = "/root/testdata/sf0.01/documents.parquet"
    phrases = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in license_scan.BASE.items())
    want = duckdb.sql(rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{data}'),
        p(phrase, label, n) AS (VALUES {phrases}),
        hit AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d), p WHERE array_to_string(list_slice(w, i + 1, i + n), ' ') = phrase)
        SELECT d.doc_id, len(w), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, w""").fetchall()
    got = license_scan.scan(spark.read.parquet(data)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[2] for r in want) > 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.render(chat.reconstruct(chat.as_events(df))).withColumn("formatted", F.encode("formatted", "UTF-8")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

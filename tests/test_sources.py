import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sievewright.functions.keys import BRANCH_PREFIX
from sievewright.sources import checkout, config, events, paged
from sievewright.streaming import archive as stream


@pytest.fixture
def tree(tmp_path):
    for name, text in {"_partial.html.erb": "e", ".eslintrc.js": "j", "src/app.ts": "t", "src/x.blade.php": "b", "node_modules/m.ts": "m", "gen/out.ts": "g", "package.json": '{"name": "top"}', "src/package.json": '{"name": "sub"}', ".gitignore": "gen/\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad.ts").write_bytes(b"\xff")
    (tmp_path / "link.ts").symlink_to("src/app.ts")
    return tmp_path


def test_walk_lists_hidden_names(spark, tree):
    df = checkout.with_content(checkout.listing(spark, str(tree)))
    got = {r.path: r.content for r in df.collect()}
    assert got["_partial.html.erb"] == b"e" and got[".eslintrc.js"] == b"j"
    assert "node_modules/m.ts" not in got and len([p for p in got if p in ("link.ts", "src/app.ts")]) == 1
    text = {r.path: r.content for r in checkout.decoded(df).collect()}
    assert text["bad.ts"] is None and text[".eslintrc.js"] == "j"
    assert [r.path for r in checkout.links(spark, str(tree)).collect()] == ["link.ts"]


def test_git_listing(spark, tree):
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    subprocess.run(["git", "-C", str(tree), "add", "src"], check=True)
    plain = {r.path for r in checkout.listing(spark, str(tree), [".ts"]).collect()}
    assert "gen/out.ts" not in plain and {"bad.ts", "node_modules/m.ts"} <= plain
    every = {r.path: r.ignored for r in checkout.listing(spark, str(tree), [".ts"], True).collect()}
    assert every["gen/out.ts"] is True
    assert {r.path for r in checkout.tracked(spark, str(tree)).collect()} == {"src/app.ts", "src/x.blade.php", "src/package.json"}


def test_languages_modules_and_rereads(spark, tree):
    files = checkout.with_content(checkout.listing(spark, str(tree)))
    lang = {r.path: r.l for r in files.select("path", checkout.language(F.col("path")).alias("l")).collect()}
    assert lang["src/x.blade.php"] == "blade" and lang["_partial.html.erb"] == "erb" and lang["package.json"] is None
    assert {r.directory: r.module for r in checkout.modules(checkout.decoded(files)).collect()} == {"": "top", "src": "sub"}
    cached = files.where("path = 'package.json'").withColumn("digest", F.sha2("content", 256))
    assert checkout.to_reread(files, cached).where("path = 'package.json'").count() == 0


def test_pages():
    pages = {None: {"items": [1], "next_cursor": "a"}, "a": {"items": None, "next_cursor": "b"}, "b": {"items": [2], "next_cursor": None}}
    assert list(paged.items(pages.get)) == [1, 2]
    for bad in ({"next_cursor": None}, {"items": 1}, {"items": [], "next_cursor": 5}, {"items": [], "next_cursor": ""}, {"items": [], "next_cursor": "x"}, []):
        with pytest.raises(paged.BadPage):
            list(paged.items(lambda c, bad=bad: bad))
    for bad in ({"key": 1, "treatment": True}, {"key": "k", "treatment": "false"}, {"key": "k", "treatment": True, "blocked_by": [1]}):
        with pytest.raises(paged.BadPage):
            paged.candidate(bad, 0)


def test_candidate_source_with_retry(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            if len(asked) == 1:
                self.send_response(503)
                self.end_headers()
                return
            body = json.dumps({"items": [{"key": f"k{'cursor' in self.path}", "treatment": True, "status": "Dead"}], "next_cursor": None if "cursor" in self.path else "c"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = paged.candidates(spark, f"http://127.0.0.1:{server.server_port}/c", staleness="dead").orderBy("seq").collect()
    server.shutdown()
    assert [(r.key, r.treatment, r.seq) for r in got] == [("kFalse", True, 0), ("kTrue", True, 1)]
    assert all("staleness=dead" in p for p in asked)


def test_config():
    c = config.from_env({"SIEVEWRIGHT_URL": "u", "SIEVEWRIGHT_ACCESSORS": "isOn, at[1], opt{key}, !off, Gate[flag?show:hide]", "SIEVEWRIGHT_KEY_ALIASES": "a-b=A_B", "SIEVEWRIGHT_MAX_PRS": "3"})
    assert [(a.name, a.position, a.prop, a.negated) for a in c.accessors] == [("isOn", 0, "", False), ("at", 1, "", False), ("opt", 0, "key", False), ("off", 0, "", True)]
    assert c.gates[0].show == "show" and c.aliases == {"a-b": "A_B"} and c.max_prs == 3
    for bad in ({"ACCESSORS": "!a[1]"}, {"ACCESSORS": "a, !a"}, {"ACCESSORS": "a-b"}, {"KEY_ALIASES": "a"}, {"KEY_ALIASES": "a=x,a=y"}, {"KEY_ALIASES": "a=x,b=x"}, {"KEY_ALIASES": "a=b,b=c"}, {"MODE": "x"}, {"MAX_PRS": "-1"}, {"STALENESS": "x"}):
        with pytest.raises(config.ConfigError):
            config.from_env({"SIEVEWRIGHT_URL": "u"} | {f"SIEVEWRIGHT_{k}": v for k, v in bad.items()})
    assert config.run_context({"GITLAB_CI": "1"}).forge == "gitlab"


def merged(key, base="main", number=1, done=True):
    return json.dumps({"action": "closed", "pull_request": {"merged": done, "number": number, "html_url": "u", "merge_commit_sha": "s", "head": {"ref": BRANCH_PREFIX + key}, "base": {"ref": base}}})


def test_events(spark):
    raw = spark.createDataFrame([(merged("a"),), (merged("b", done=False),), (merged("=6F"),), ("no json",)], "value string")
    assert [(r.key, r.pull_request) for r in events.merged_requests(raw).collect()] == [("a", 1)]
    said = spark.createDataFrame([(json.dumps({"action": "created", "issue": {"number": 4, "pull_request": {"url": "u"}}, "comment": {"id": 9, "body": "@sievewright rerun"}}),), (json.dumps({"action": "created", "issue": {"number": 5}, "comment": {"id": 1, "body": "@sievewright rerun"}}),)], "value string")
    assert [(r.pull_request, r.command) for r in events.commands(said).collect()] == [(4, "rerun")]
    shipped = events.deployments(spark.createDataFrame([(json.dumps({"deployment": {"environment": "Production", "sha": "t"}, "deployment_status": {"id": 7, "state": "SUCCESS"}}),)], "value string"))
    due = spark.createDataFrame([("a", "s"), ("b", "z")], "key string, merge_commit_sha string")
    reach = spark.createDataFrame([("t", "s")], "sha string, ancestor string")
    assert [(r.event_id, r.key) for r in stream.archived_on_deploy(shipped, "production", due, reach).collect()] == [(7, "a")]


def test_merge_stream_is_idempotent(spark, tmp_path):
    live = spark.createDataFrame([("a",)], "key string")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(merged("a"))
    (folder / "2.json").write_text(merged("b"))
    for k in range(2):
        (folder / f"again{k}.json").write_text(merged("a"))
        stream.stream(spark, str(folder), str(tmp_path / "c"), str(tmp_path / "out"), lambda r: stream.archived_on_merge(r, live, "main").distinct()).awaitTermination(120)
    got = sorted((r.key, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "archive"), ("b", "skip")]


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "x") for m in (1, 2, 11, 59)], "ts string, kind string")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = stream.outcome_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from counts").collect()) == [1, 1, 2]

"""Relational slices: the operators on ordinary tables, each with the SQL that it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text, tokens
from ..model import CANDIDATES
from ..operators import agreement, archive, candidates, mentions, passages, relational, report, resolve, syntax
from ..sources import checkout, events
from ..sources.config import Accessor
from ..streaming import archive as streamed
from . import parameters, predicted, remove, spread, symbols

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slice_of(sql: str):
    """Registers a query of (read,) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        ORACLE[f.__name__] = sql
        return f

    return register


#: More names than are searched for one by one, some of several tokens, one that no text has and one that is part of a word.
NAMES = (
    "the", "of", "license", "de", "Apache", "licensed", "version", "no-such-key", "and", "in", "to", "on", "un", "une", "le", "la", "les", "et", "der", "die", "das", "und", "ist",
    "el", "los", "con", "por", "que", "this", "that", "with", "from", "MIT", "BY", "Apache License", "MIT License", "CC BY", "h", "http", "the of",
)


def _word(name: str, inside: str) -> str:
    return f"regexp_matches(text, '(^|[^{inside}]){name}([^{inside}]|$)')"


@slice_of(" UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) FILTER (WHERE {_word(n, 'A-Za-z0-9_-')}) AS BIGINT) AS n FROM documents" for n in NAMES))
def mention_count(read):
    """Documents that mention each name as a whole token."""
    docs = read("documents")
    names = docs.sparkSession.createDataFrame([(n,) for n in NAMES], "name string")
    return mentions.mention_count(docs, names, path="doc_id", content="text")


@slice_of(f"SELECT doc_id, {_word('license', 'A-Za-z0-9_-')} AS names_key FROM documents")
def token_predicate(read):
    """Whether each document mentions one key, by the predicate instead of the join."""
    return read("documents").select("doc_id", tokens.mentions_key(F.col("text"), "license", True).alias("names_key"))


@slice_of("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_mentions(read):
    """Documents that hold a benchmark item's whole text."""
    return passages.containing(read("documents"), read("benchmark"), "doc_id", "item_id")


@slice_of("SELECT text, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_spelling(read):
    """One row of each text, that of the first document."""
    return relational.first_by(read("documents").select("text", "doc_id", "lang"), ["text"], ["doc_id"])


@slice_of("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def action_tally(read):
    return relational.tally(read("events"), "event_type")


_DENY, _ALLOW = ("Brand#2", "Brand#17"), ("Brand#2", "Brand#3", "Brand#4", "Brand#11", "Brand#12")


@slice_of(f"""
WITH c AS (SELECT p_brand || '/' || p_name AS key, p_partkey AS seq, p_brand, p_size FROM part),
f AS (SELECT *, CASE WHEN key LIKE 'Brand#2/%' THEN 'ignored' WHEN p_brand NOT IN ({", ".join(f"'{b}'" for b in _ALLOW)}) THEN 'not-selected' END AS a FROM c),
g AS (SELECT *, CASE WHEN a IS NULL THEN row_number() OVER (PARTITION BY key, a IS NULL ORDER BY seq) END AS r FROM f)
SELECT seq, CASE WHEN a IS NOT NULL THEN a WHEN r > 1 THEN 'duplicate' WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size % 7 = 0 THEN 'already-handled' ELSE 'open' END AS action FROM g""")
def candidate_actions(read):
    """Parts as candidates: deny, allow, duplicates, blocked, handled, in order. Brands and names stand for flags."""
    part = read("part").withColumn("code", F.regexp_replace(F.concat_ws("_", "p_brand", "p_name"), "[^A-Za-z0-9_]", "_"))
    rows = part.select(F.col("code").alias("key"), F.lit("stale").alias("reason"), F.lit(True).alias("treatment"), F.lit("Stale").alias("status"), F.when(F.col("p_size") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("blocked_by"), F.col("p_partkey").alias("seq"))
    brand = lambda b: b.replace("#", "_")
    # Keys begin with the brand, so the lists are patterns.
    deny, allow = [brand("Brand#2") + "_*"], [brand(b) + "_*" for b in _ALLOW]
    done = candidates.decide(rows, deny, allow).withColumn("handled", F.lit(None).cast("string"))
    seven = part.where("p_size % 7 = 0").select(F.col("p_partkey").alias("seq"), F.lit("already-handled").alias("late"))
    return done.join(seven, "seq", "left").select("seq", F.coalesce("action", "late", F.lit("open")).alias("action"))


@slice_of("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#2', 'Brand#17') THEN 'ignored' WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN 'not-selected' ELSE 'open' END AS action FROM part")
def deny_allow(read):
    """Deny wins over allow."""
    rules = [("ignored", F.col("p_brand").isin(*_DENY)), ("not-selected", ~F.col("p_type").isin("ECONOMY", "PROMO"))]
    return relational.classify(read("part").select("p_partkey", "p_brand", "p_type"), rules, "action", "open").select("p_partkey", "action")


@slice_of("""SELECT event_id FROM (SELECT event_id, CAST(event_type = 'purchase' AS INT) AS c,
sum(CAST(event_type = 'purchase' AS INT)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s - c < 500""")
def conditional_limit(read):
    """Events up to the 500th purchase; others are free."""
    return relational.limited(read("events"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type") == "purchase", 500, ["event_id"]).select("event_id")


@slice_of("SELECT event_id, CAST(count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM events")
def running_count(read):
    """The number of events so far, without one task for all rows."""
    return relational.running_total(read("events"), F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1).cast("long"), "n", ["event_id"]).select("event_id", "n")


@slice_of("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def unique_decl(read):
    return relational.unique(read("documents").select("doc_id", "text"), ["text"]).select("doc_id")


@slice_of("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 10)")
def forall_proven(read):
    return relational.proven(read("lineitem"), ["l_orderkey"], F.col("l_quantity") >= 10)


@slice_of("""SELECT c_custkey AS key, max(o_orderkey) AS pull_request FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F' GROUP BY c_custkey""")
def outstanding(read):
    """Customers of a region stand for live flags, their finished orders for merged removals; the last of each."""
    live = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").cast("string").alias("key"))
    merged = read("orders").select(keys.removal_branch(F.col("o_custkey").cast("string")).alias("branch"), F.col("o_orderstatus").alias("base"), F.col("o_orderkey").alias("pull_request"), F.lit("").alias("url"), F.lit("").alias("merge_commit_sha"))
    return archive.outstanding(live, merged, "F").select(F.col("key").cast("long").alias("key"), "pull_request")


@slice_of("""SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, ' | ') THEN 'table'
WHEN n_chars < 400 THEN 'short' ELSE 'other' END AS class FROM documents""")
def residue_class(read):
    """Disjoint classes by the first rule that holds."""
    t = F.col("text")
    rules = [("licence", F.contains(t, F.lit("License"))), ("shout", F.contains(t, F.lit("!!"))), ("table", F.contains(t, F.lit(" | "))), ("short", F.col("n_chars") < 400)]
    return relational.classify(read("documents"), rules, otherwise="other").select("doc_id", "class")


@slice_of("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST(min(i) AS INT) AS line, arg_min(t, i) AS text FROM l WHERE contains(t, ' the ') GROUP BY doc_id""")
def line_lookup(read):
    """The first line of each document that holds a needle."""
    found = read("documents").select("doc_id", text.line_of(F.col("text"), F.lit(" the ")).alias("f"))
    return found.where("f is not null").select("doc_id", "f.line", "f.text")


_TOKENS = "regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*')"
_FUSED, _OWN = _TOKENS.format("replace(text, ' th', 'th')"), _TOKENS.format("text")


@slice_of(f"SELECT doc_id, len(list_distinct({_FUSED})) - len(list_intersect({_FUSED}, {_OWN})) AS n FROM documents")
def token_set_diff(read):
    """Identifiers that a rewrite (some blanks taken out) fused."""
    return read("documents").select("doc_id", F.size(tokens.fused(F.col("text"), F.replace("text", F.lit(" th"), F.lit("th")))).cast("long").alias("n"))


@slice_of("SELECT p_partkey, 'cleanup/remove-flag/' || replace(replace(replace(p_name || '/' || p_brand, '#', '=23'), ' ', '=20'), '/', '=2F') AS branch, p_name || '/' || p_brand AS key FROM part")
def branch_round_trip(read):
    """Keys as branches, and back."""
    rows = read("part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("k")).select("p_partkey", keys.removal_branch(F.col("k")).alias("branch"))
    return rows.select("p_partkey", "branch", keys.key_of_branch(F.col("branch")).alias("key"))


@slice_of("""SELECT l_orderkey, min(l_returnflag) AS value FROM lineitem GROUP BY l_orderkey
HAVING min(l_returnflag) = max(l_returnflag) AND bool_and(l_quantity >= 5)""")
def constant_arguments(read):
    """Orders as parameters: one value at every line, all of them of the right kind."""
    calls = read("lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), (F.col("l_quantity") >= 5).alias("literal"))
    return agreement.constant_arguments(calls, ["l_orderkey"])


@slice_of("SELECT l_orderkey AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS value FROM lineitem GROUP BY l_orderkey")
def registry_default(read):
    return agreement.registry_default(read("lineitem").select(F.col("l_orderkey").alias("flag"), F.col("l_linestatus").alias("value")))


@slice_of("""WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09)
SELECT l_orderkey AS flag, l_linenumber AS path FROM lineitem ANTI JOIN bad USING (l_orderkey)""")
def all_or_nothing(read):
    """Lines of orders none of whose lines was refused."""
    rows = read("lineitem").select(F.col("l_orderkey").alias("flag"), F.col("l_linenumber").alias("path"), F.when(F.col("l_discount") > 0.09, "discount").alias("reason"))
    return agreement.all_or_nothing(rows).select("flag", "path")


@slice_of("""SELECT e.event_id, o.event_id AS span FROM events e JOIN (SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 120 AS t FROM events WHERE event_type = 'error') o
ON epoch_us(e.ts) // 1000000 >= o.s AND epoch_us(e.ts) // 1000000 < o.t WHERE e.event_type = 'purchase'""")
def point_in_span(read):
    """Purchases within two minutes after an error: a range join by bins."""
    e = read("events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("all", F.lit(1))
    spans = e.where("event_type = 'error'").select("all", F.col("event_id").alias("span"), F.col("at").alias("s"), (F.col("at") + 120).alias("t"))
    return relational.contained(e.where("event_type = 'purchase'").select("all", "event_id", "at"), spans, "all", "at", "s", "t", 120).select("event_id", "span")


@slice_of("""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
m AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[a-z][a-z])/', 1) AS d FROM f WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) FROM f WHERE page_id % 3 = 0)
SELECT page_id, arg_max(d, length(d)) AS module FROM f LEFT JOIN m ON d <> '' AND starts_with(path, d || '/') GROUP BY page_id""")
def nearest_module(read):
    """The nearest directory above each page's path that is a module."""
    files = read("pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    deep = files.where("page_id % 2 = 0").select(F.regexp_extract("path", "^([^/]+/[a-z][a-z])/", 1).alias("directory"))
    top = files.where("page_id % 3 = 0").select(F.regexp_extract("path", "^([^/]+)", 1).alias("directory"))
    modules = deep.union(top).where("directory <> ''").distinct().withColumn("module", F.col("directory"))
    return resolve.modules_of(files, modules).select("page_id", "module")


@slice_of("""SELECT conv_id AS pull, arg_max(role, turn) = 'user' AS was_draft FROM conversations WHERE role <> 'assistant' GROUP BY conv_id HAVING arg_max(role, turn) <> 'system'""")
def active_holds(read):
    """Conversations as comment lists: users' turns hold, system turns release."""
    marker = F.when(F.col("role") == "user", "<!-- flag-hold draft=true -->").when(F.col("role") == "system", archive.RELEASE_MARKER).otherwise("")
    rows = read("conversations").select(F.col("conv_id").alias("pull"), (F.col("role") != "assistant").alias("trusted"), F.col("turn").alias("created_at"), marker.alias("body"))
    return archive.active_holds(rows)


@slice_of("SELECT doc_id, regexp_extract(text, '(?m)^([^ ]+)', 1) AS head, CAST(len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])Apache')) AS INT) AS n FROM documents WHERE contains(text, 'Apache')")
def reference_count(read):
    """How often documents name an identifier."""
    docs = read("documents").where(F.contains("text", F.lit("Apache")))
    return docs.select("doc_id", F.regexp_extract("text", r"(?m)^([^ ]+)", 1).alias("head"), tokens.references(F.col("text"), "Apache").alias("n"))


@slice_of("SELECT '[' || o_orderstatus || '] order-' || o_orderkey || ' (status=' || o_orderpriority || ', treatment=' || CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END || ')' AS line FROM orders")
def report_lines(read):
    o = read("orders")
    return o.select(report.line(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice") > 200000, F.lit("")).alias("line"))


@slice_of("SELECT n_name AS name FROM nation WHERE n_regionkey IN (0, 2) UNION SELECT r_name FROM region WHERE r_regionkey IN (0, 2) UNION SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)")
def alias_closure(read):
    """Regions, their nations and their customers: all names that two regions are handed on under."""
    n = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    renames = n.select(F.col("r_name").alias("original"), F.col("n_name").alias("alias")).union(c.select("n_name", "c_name"))
    return mentions.with_aliases(read("region").where("r_regionkey in (0, 2)").select(F.col("r_name").alias("name")), renames)


def _sources(read):
    """Orders as files, each with one read of one of seven flags."""
    flag = F.concat(F.lit("flag-"), (F.col("o_custkey") % 7).cast("string"))
    content = F.concat(F.lit("const v = client.isEnabled('"), flag, F.lit("') ? a("), F.col("o_orderkey").cast("string"), F.lit(") : b;\n"))
    return read("orders").select(F.col("o_orderkey").cast("string").alias("path"), content.alias("content"))


def _flags(spark):
    return spark.createDataFrame([(f"flag-{k}", "", k % 2 == 0, "Dead", [], k) for k in range(7)], CANDIDATES)


_ON = "o_custkey % 7 % 2 = 0"
_BEFORE = "'const v = client.isEnabled(''flag-' || (o_custkey % 7) || ''') ? a(' || o_orderkey || ') : b;'"
_AFTER = f"CASE WHEN {_ON} THEN 'const v = a(' || o_orderkey || ');' ELSE 'const v = b;' END"


@slice_of(f"SELECT o_orderkey, 'flag-' || (o_custkey % 7) AS flag, {_AFTER} || chr(10) AS after FROM orders")
def fold_reads(read):
    """Every read folded to the value served: the mention join, then one fold for each pair of flag and file."""
    files = _sources(read)
    open_flags = candidates.decide(_flags(files.sparkSession)).where("action is null")
    met = remove.pairs(open_flags, files).withColumn("language", F.lit("ts"))
    return remove.folded(met, [Accessor("isEnabled")]).select(F.col("path").cast("long").alias("o_orderkey"), "flag", "after")


@slice_of(f"""SELECT o_orderkey, '--- a/' || o_orderkey || chr(10) || '+++ b/' || o_orderkey || chr(10) || '@@ -1 +1 @@' || chr(10)
|| '-' || {_BEFORE} || chr(10) || '+' || {_AFTER} || chr(10) AS diff FROM orders""")
def file_diffs(read):
    """Unified diffs of the folds of all flags."""
    files = _sources(read)
    open_flags = candidates.decide(_flags(files.sparkSession)).where("action is null")
    done = remove.folded(remove.pairs(open_flags, files).withColumn("language", F.lit("ts")), [Accessor("isEnabled")])
    return done.select(F.col("path").cast("long").alias("o_orderkey"), text.diff("path", "before", "after").alias("diff"))


@slice_of("SELECT o_orderkey, '{\"id\": ' || o_orderkey || ', \"s\": {\"kept\": 1}}' AS text FROM orders")
def json_edit(read):
    """A key cut out of a section of JSON with comments, byte for byte otherwise."""
    source = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "s": {"kept": 1, /* gone */ "flag": {"x": [1, "}"]}}}'))
    done = text.without_keys(source, F.lit("s"), F.array(F.lit("flag")))
    return read("orders").select("o_orderkey", done["text"].alias("text"))


@slice_of("SELECT CAST(o_orderkey AS INT) AS pull_request, 'key/' || o_custkey AS key FROM orders WHERE o_orderstatus = 'F'")
def merged_events(read):
    """Orders as events of requests: those merged, with the key that their branch stands for."""
    head = F.struct(F.concat(F.lit(keys.BRANCH_PREFIX), F.lit("key=2F"), F.col("o_custkey").cast("string")).alias("ref"))
    request = F.struct((F.col("o_orderstatus") == "F").alias("merged"), F.col("o_orderkey").cast("int").alias("number"), F.lit("u").alias("html_url"), F.lit("s").alias("merge_commit_sha"), head.alias("head"), F.struct(F.lit("main").alias("ref")).alias("base"))
    raw = read("orders").select(F.to_json(F.struct(F.lit("closed").alias("action"), request.alias("pull_request"))).alias("value"))
    return events.merged_requests(raw).select("pull_request", "key")


@slice_of("""SELECT n_name AS name, 'left' AS side FROM (SELECT n_name FROM nation EXCEPT ALL SELECT r_name FROM region) UNION ALL SELECT r_name, 'right' FROM (SELECT r_name FROM region EXCEPT ALL SELECT n_name FROM nation)
UNION ALL SELECT text, 'left' FROM (SELECT text FROM benchmark EXCEPT ALL SELECT text FROM documents) UNION ALL SELECT text, 'right' FROM (SELECT text FROM documents EXCEPT ALL SELECT text FROM benchmark)""")
def symdiff(read):
    """Rows that one of two tables lacks, as often as they are over."""
    names = relational.difference(read("nation").select(F.col("n_name").alias("name")), read("region").select(F.col("r_name").alias("name")))
    return names.unionByName(relational.difference(read("benchmark").select(F.col("text").alias("name")), read("documents").select(F.col("text").alias("name"))))


@slice_of(f"SELECT doc_id AS path, n.name FROM documents d JOIN (VALUES {', '.join(f"('{n}')" for n in NAMES)}) n(name) ON regexp_matches(d.text, '(^|[^A-Za-z0-9_])' || n.name || '([^A-Za-z0-9_]|$)')")
def residual_mentions(read):
    """Files after a rewrite that still name something deleted."""
    names = read("documents").sparkSession.createDataFrame([(n,) for n in NAMES], "name string")
    return resolve.survivors(read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), names)


@slice_of(f"SELECT doc_id FROM documents WHERE NOT ({_word('License', 'A-Za-z0-9_-')} AND source = 'src0') AND {_word('License', 'A-Za-z0-9_-')}")
def live_references(read):
    """Documents with a live mention of a key; those of one source are inert."""
    docs = read("documents").select("doc_id", F.col("text").alias("content"), "source")
    live = mentions.live_references(docs, "License", F.col("source") == "src0")
    return live.where(tokens.mentions_key(F.col("content"), "License", True)).select("doc_id")


_TREE = "(SELECT c_custkey AS sha, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1)"
_UP = f"up AS (SELECT c_custkey AS sha, c_custkey AS ancestor FROM customer UNION ALL SELECT up.sha, t.parent FROM up JOIN {_TREE} t ON up.ancestor = t.sha)"


def _commits(read):
    """Customers as commits: each has half its number as parent."""
    sha = F.col("c_custkey").cast("string")
    return read("customer").select(sha.alias("sha"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2).cast("string")).alias("parent"))


@slice_of(f"""WITH RECURSIVE {_UP}, refs AS (SELECT s_suppkey AS seq, 's' || s_suppkey AS ref, (SELECT max(c_custkey) FROM customer) - s_suppkey AS sha FROM supplier WHERE s_suppkey <= 3)
SELECT o_orderkey, (SELECT arg_min(r.ref, r.seq) FROM refs r WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.sha = r.sha AND up.ancestor = o_custkey)) AS missing FROM orders""")
def containment(read):
    """Orders as removals, merged at their customer's commit, and the first of three refs that lacks it."""
    commits = _commits(read)
    last = commits.agg(F.max(F.col("sha").cast("long")).alias("n"))
    refs = read("supplier").where("s_suppkey <= 3").crossJoin(F.broadcast(last)).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ref"), (F.col("n") - F.col("s_suppkey")).cast("string").alias("sha"), F.col("s_suppkey").alias("seq"))
    rows = read("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("merge_commit_sha"))
    held, waits = archive.by_containment(rows, refs, archive.ancestry(commits, refs))
    return held.select("o_orderkey", F.lit(None).cast("string").alias("missing")).union(waits.select("o_orderkey", "missing"))


@slice_of(f"""WITH RECURSIVE {_UP}, e AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 10)
SELECT DISTINCT e.event_id, 'k' || o_orderkey AS key FROM e JOIN up ON up.sha = e.user_id JOIN orders ON o_custkey = up.ancestor AND o_orderstatus = 'F'""")
def deploy_archives(read):
    """Events as deployments of their user's commit, and the finished orders that those contain."""
    text_ = lambda c: F.col(c).cast("string")
    status = F.struct(F.col("event_id").alias("id"), F.when(F.col("value") > 10, "Success").otherwise("failure").alias("state"), F.lit("Production").alias("environment"))
    raw = read("events").where("event_type = 'purchase'").select(F.to_json(F.struct(F.struct(F.lit("staging").alias("environment"), text_("user_id").alias("sha")).alias("deployment"), status.alias("deployment_status"))).alias("value"))
    waiting = read("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("k"), text_("o_orderkey")).alias("key"), text_("o_custkey").alias("merge_commit_sha"))
    seen = events.deployments(raw)
    return streamed.archived_on_deploy(seen, "production", waiting, archive.ancestry(_commits(read), seen.select("sha").distinct()))


@slice_of("""SELECT 'c' || o_custkey AS key, CAST(o_orderkey AS INT) AS pull_request, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'ignore' WHEN c.c_acctbal > 0 THEN 'archive' ELSE 'skip' END AS outcome
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""")
def merge_archives(read):
    """Finished orders as merged removals: archived if the customer's flag lives and the base is the main one."""
    head = F.struct(F.concat(F.lit(keys.BRANCH_PREFIX), F.lit("c"), F.col("o_custkey").cast("string")).alias("ref"))
    request = F.struct((F.col("o_orderstatus") == "F").alias("merged"), F.col("o_orderkey").cast("int").alias("number"), F.lit("u").alias("html_url"), F.lit("s").alias("merge_commit_sha"), head.alias("head"), F.struct(F.col("o_orderpriority").alias("ref")).alias("base"))
    raw = read("orders").select(F.to_json(F.struct(F.lit("closed").alias("action"), request.alias("pull_request"))).alias("value"))
    return streamed.archived_on_merge(raw, read("customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key")), "1-URGENT")


@slice_of("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'rerun' WHEN 'system' THEN 'recreate' END AS command FROM conversations")
def comment_commands(read):
    """Turns as comments that give commands: users rerun, systems recreate, what others say stands in code or prose."""
    say = lambda verb: F.concat(F.lit(f"please\n{archive.COMMAND_PREFIX}  {verb}  \n"), F.lit("thanks"))
    body = F.when(F.col("role") == "user", say("Rerun")).when(F.col("role") == "system", say("recreate")).otherwise(f"```\n{archive.COMMAND_PREFIX} rerun\n```\nor {archive.COMMAND_PREFIX} rerun")
    return read("conversations").select("conv_id", "turn", archive.command(body).alias("command"))


_NEST = "'f(' || repeat('[{', CAST(p_size AS INT)) || repeat('}]', CAST(p_size AS INT)) || ')]'"


@slice_of("SELECT p_partkey AS path, CAST(2 * p_size + 1 AS INT) AS depth FROM part WHERE 2 * p_size + 1 >= 40")
def deep_files(read):
    """Parts as files that are nested as deep as their size says."""
    content = F.concat(F.lit("f("), F.repeat(F.lit("[{"), F.col("p_size")), F.repeat(F.lit("}]"), F.col("p_size")), F.lit(")]"))
    return agreement.deep_files(read("part").select(F.col("p_partkey").alias("path"), content.alias("content")), 40).select("path", "depth")


_FIRST = "regexp_extract(text, '[A-Za-z0-9_]+')"


@slice_of(f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS w FROM documents), c AS (SELECT doc_id AS path, {_FIRST} AS name FROM documents)
SELECT path, name, EXISTS (SELECT 1 FROM t WHERE w = c.name AND t.doc_id <> c.path) AS elsewhere FROM c""")
def named_elsewhere(read):
    """The first word of each document as its constant, and whether another document names it."""
    files = read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    constants = files.select("path", F.regexp_extract("content", "[A-Za-z0-9_]+", 0).alias("name"))
    return mentions.elsewhere(constants, files)


@slice_of(f"""WITH t AS (SELECT doc_id AS other, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS w FROM documents),
d AS (SELECT DISTINCT doc_id AS path, lang AS module, source AS owner, {_FIRST} AS name FROM documents),
r AS (SELECT doc_id AS path, lang AS module, source AS owner, regexp_extract_all(text, '[A-Za-z0-9_]+')[2] AS name, n_chars % 2 = 0 AS removable FROM documents UNION ALL SELECT path, module, owner, name, true FROM d),
q AS (SELECT *, count(*) OVER (PARTITION BY module, owner, name) AS k FROM d),
ok AS (SELECT path AS other, module, owner, name, bool_and(removable) AS ok FROM r GROUP BY ALL),
far AS (SELECT q.path, q.module, q.owner, q.name, bool_and(coalesce(ok.ok, false)) AS free FROM q JOIN t ON w = q.name AND t.other <> q.path LEFT JOIN ok ON ok.other = t.other AND ok.module = q.module AND ok.owner = q.owner AND ok.name = q.name WHERE k = 1 GROUP BY ALL)
SELECT q.path, q.name, CASE WHEN k > 1 THEN 'declared more than once' WHEN NOT coalesce(far.free, true) THEN 'a mention isn''t proven' WHEN NOT coalesce(own.ok, true) THEN 'a use in its own file stays' END AS reason
FROM q LEFT JOIN far USING (path, module, owner, name) LEFT JOIN ok own ON own.other = q.path AND own.module = q.module AND own.owner = q.owner AND own.name = q.name""")
def declarations_proven(read):
    """The first word of each document as a declaration, first and second words as references: what can go, and why the rest stays."""
    docs = read("documents")
    word = lambda k: F.get(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lit(k)).alias("name")
    named = [F.col("doc_id").alias("path"), F.col("lang").alias("module"), F.col("source").alias("owner")]
    declared = docs.select(*named, word(0)).withColumn("key", F.lit("k")).withColumn("name", F.coalesce("name", F.lit("")))
    used = docs.select(*named, word(1), (F.col("n_chars") % 2 == 0).alias("removable")).union(declared.select("path", "module", "owner", "name", F.lit(True)))
    out = resolve.resolve(declared, used, docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return out["deletable"].select("path", "name", F.lit(None).cast("string").alias("reason")).union(out["blocked"].select("path", "name", "reason"))


@slice_of("SELECT l_orderkey AS path, l_partkey AS name FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING min(l_orderkey) < max(l_orderkey))")
def competing_names(read):
    """Parts as names and orders as files: declarations whose name another file declares too."""
    return resolve.competing(read("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("name")))


def _lines(read, *more):
    return read("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("module"), F.col("l_linestatus").alias("owner"), F.col("l_partkey").alias("name"), *more)


@slice_of("""SELECT l_orderkey AS path, l_partkey AS name FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 49 AND b.l_returnflag = l.l_returnflag AND b.l_linestatus = l.l_linestatus AND b.l_partkey = l.l_partkey)""")
def readers_of_what_goes(read):
    """Readers without those of declarations that stay."""
    rows = _lines(read, "l_quantity")
    return resolve.void_readers(rows, rows.where("l_quantity > 49")).select("path", "name")


@slice_of("""SELECT o_orderkey AS path FROM (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def writable_files(read):
    """Files that a run may write: mentions, readers and callers, without what others claim."""
    o = read("orders").withColumnRenamed("o_orderkey", "path")
    return resolve.candidate_files(read("lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "path"), o.where("o_orderstatus = 'P'"), o.where("o_totalprice > 300000"), o.where("o_orderpriority = '1-URGENT'"))


@slice_of("SELECT l_orderkey AS path, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)")
def uncovered_uses(read):
    """Uses in files that no parser covers."""
    uses = read("lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber")
    return resolve.uncovered(uses, read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")))


@slice_of("""WITH RECURSIVE e AS (SELECT c_custkey AS m, CASE WHEN c_custkey % 10 <> 0 AND c_custkey + 1 <= (SELECT max(c_custkey) FROM customer) THEN c_custkey + 1 END AS src, c_nationkey = 3 AS lost FROM customer),
w AS (SELECT m AS reader, m FROM e UNION ALL SELECT w.reader, e.src FROM w JOIN e ON e.m = w.m WHERE e.src IS NOT NULL AND NOT e.lost)
SELECT CAST(reader AS VARCHAR) AS reader, max(CASE WHEN e.src IS NULL AND NOT e.lost THEN CAST(e.m AS VARCHAR) END) AS module FROM w LEFT JOIN e ON e.m = w.m GROUP BY reader""")
def reexport_chains(read):
    """Customers as modules that export a name again from the next one; a tenth declare it, and some lack it."""
    last = read("customer").agg(F.max("c_custkey").alias("n"))
    c = read("customer").crossJoin(F.broadcast(last))
    again = (F.col("c_custkey") % 10 != 0) & (F.col("c_custkey") < F.col("n"))
    id_ = lambda x: F.col(x).cast("string")
    exports = c.where("c_nationkey <> 3").select(id_("c_custkey").alias("module"), F.lit("x").alias("name"), F.when(again, (F.col("c_custkey") + 1).cast("string")).alias("source"))
    return resolve.provider(read("customer").select(id_("c_custkey").alias("reader"), F.lit("x").alias("name"), id_("c_custkey").alias("module")), exports).select("reader", "module")


@slice_of("""WITH i AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS specifier FROM pages), p AS (SELECT DISTINCT regexp_extract(specifier, '^[^/]+', 0) AS package FROM i UNION SELECT DISTINCT regexp_extract(specifier, '^[^/]+/[^/]+', 0) FROM i WHERE specifier LIKE '%/%')
SELECT page_id, arg_max(package || '/index.ts', length(package)) AS source FROM i LEFT JOIN p ON package <> '' AND (specifier = package OR starts_with(specifier, package || '/')) GROUP BY page_id""")
def workspace_sources(read):
    """Pages' addresses as bare specifiers, hosts and their first folders as packages."""
    i = read("pages").select(F.col("page_id").alias("reader"), F.regexp_replace("url", "^[a-z]+://", "").alias("specifier"))
    part = lambda p: i.select(F.regexp_extract("specifier", p, 0).alias("package"))
    packages = part("^[^/]+").union(part("^[^/]+/[^/]+")).where("package <> ''").distinct().withColumn("source", F.concat("package", F.lit("/index.ts")))
    return resolve.workspace_source(i, packages).select(F.col("reader").alias("page_id"), "source")


@slice_of("""SELECT c_custkey AS path, c_name AS name FROM customer WHERE c_name IN (SELECT c_name FROM customer GROUP BY c_name HAVING count(DISTINCT c_custkey) = 1)
AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND c_name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')""")
def qualified_wrappers(read):
    """Customers as wrappers: a name declared once, an owner without a subclass, nothing published."""
    c = read("customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner"), "c_mktsegment")
    return resolve.qualified(c, c, read("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("owner")), c.where("c_mktsegment = 'BUILDING'")).select("path", "name")


@slice_of("""WITH t AS (SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS type FROM orders GROUP BY o_custkey)
SELECT o_orderkey, coalesce(t.type = o.o_orderstatus, false) AS proven FROM orders o LEFT JOIN t USING (o_custkey)""")
def bound_calls(read):
    """Orders as calls on their customer, whose one type is the status of all the customer's orders."""
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("path"), F.lit("r").alias("receiver"), F.col("o_orderstatus").alias("type"))
    calls = o.select("o_orderkey", "path", "receiver", F.col("type").alias("name"))
    return resolve.bound_calls(calls, o, o.select(F.col("type").alias("name"), F.col("type").alias("owner"))).select("o_orderkey", "proven")


@slice_of("SELECT c_custkey AS name, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n FROM customer")
def closed_out(read):
    """Customers as wrappers, and how many open orders still reference each."""
    gone, kept = resolve.close_out(read("customer").select(F.col("c_custkey").alias("name")), read("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("name")))
    return gone.select("name", F.lit(0).cast("long").alias("n")).union(kept.select("name", F.size("paths").cast("long")))


@slice_of("SELECT DISTINCT l_returnflag AS module, l_partkey AS name FROM lineitem WHERE l_quantity < 2")
def held_tables(read):
    """Parts as exported tables that some line reads by anything but a literal key."""
    return resolve.held_tables(_lines(read, (F.col("l_quantity") >= 2).alias("literal"))).select("module", "name")


@slice_of("SELECT s_suppkey AS seq FROM supplier JOIN nation ON 'n' || s_nationkey = 'n' || n_nationkey WHERE s_suppkey <> n_nationkey")
def alias_conflicts(read):
    """Suppliers spelt like a nation's key."""
    c = read("supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("key"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("code_key"))
    return candidates.alias_conflicts(c, read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))).select("seq")


@slice_of("""SELECT arg_min(path, (source, seq, path)) AS path, resolved FROM (SELECT l_orderkey AS path, l_partkey AS resolved, l_linenumber AS seq, 0 AS source FROM lineitem WHERE l_quantity > 40
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 1 FROM lineitem WHERE l_quantity <= 40) GROUP BY resolved""")
def unprocessed_files(read):
    """What mentions a flag, then what was skipped: one row for each resolved path under its first spelling."""
    rows = read("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("resolved"), F.col("l_linenumber").alias("seq"), "l_quantity")
    return mentions.unprocessed(rows.where("l_quantity > 40"), rows.where("l_quantity <= 40"))


@slice_of("SELECT l_partkey AS path, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS owner FROM lineitem GROUP BY l_partkey")
def first_owners(read):
    """The supplier of each part's first line."""
    # A part may have two suppliers on one line; the row that stands first in the table's files is the first.
    at = F.struct("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    return agreement.first_owner(read("lineitem").select(F.col("l_partkey").alias("path"), at.alias("seq"), F.col("l_suppkey").alias("owner"))).select("path", "owner")


@slice_of("SELECT l_partkey AS constructor, l_linenumber AS parameter FROM lineitem GROUP BY ALL HAVING bool_and(l_quantity > 5)")
def removable_parameters(read):
    """Parameters that all sites agree to lose."""
    return agreement.removable_parameters(read("lineitem").select(F.col("l_partkey").alias("constructor"), F.col("l_linenumber").alias("parameter"), (F.col("l_quantity") > 5).alias("ok")))


@slice_of("SELECT event_id, value FROM events WHERE starts_with(event_type, 'p')")
def rewrite_rows(read):
    """Rows of a log whose rule begins so."""
    return agreement.rule_rows(read("events").withColumnRenamed("event_type", "rule"), "p").select("event_id", "value")


@slice_of("SELECT o_orderkey, n_name AS kind FROM orders JOIN nation ON n_nationkey = o_custkey % 30")
def rule_bindings(read):
    """Rows of a log with the kind of binding that their rule writes."""
    log = read("orders").select("o_orderkey", (F.col("o_custkey") % 30).cast("int").alias("rule"))
    return agreement.bindings(log, read("nation").select(F.col("n_nationkey").alias("rule"), F.col("n_name").alias("kind"))).select("o_orderkey", "kind")


_USES = "SELECT l_orderkey AS path, l_returnflag AS name, l_linenumber = 1 AS binds, l_quantity > 3 AS removable FROM lineitem"


def _uses(read):
    return read("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("name"), (F.col("l_linenumber") == 1).alias("binds"), (F.col("l_quantity") > 3).alias("removable"))


@slice_of(f"SELECT path, name FROM ({_USES}) GROUP BY ALL HAVING count(*) FILTER (WHERE binds) = 1 AND bool_and(removable OR binds)")
def safe_bindings(read):
    """Constants bound once all of whose other uses can go."""
    return agreement.binding_safe(_uses(read))


@slice_of(f"""SELECT * FROM (SELECT path, name, CASE WHEN count(*) FILTER (WHERE binds) = 0 THEN 'never bound' WHEN count(*) FILTER (WHERE binds) > 1 THEN 'bound more than once'
WHEN NOT bool_and(removable OR binds) THEN 'used where it can''t be removed' END AS reason FROM ({_USES}) GROUP BY path, name) WHERE reason IS NOT NULL""")
def withheld_bindings(read):
    """Why other constants are withheld."""
    return agreement.withheld(_uses(read))


@slice_of(f"SELECT doc_id AS path FROM documents WHERE {_word('License', 'A-Za-z0-9_-')} AND {_word('the', 'A-Za-z0-9_')}")
def co_mentions(read):
    """Documents that name both an accessor and a key."""
    return agreement.co_mentions(read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "License", "the").select("path")


@slice_of("SELECT l_orderkey AS path, l_linenumber AS entry FROM lineitem WHERE l_linestatus = 'O'")
def contradicting_entries(read):
    """Entries whose value is the literal that goes."""
    return agreement.contradicting(read("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("entry"), F.col("l_linestatus").alias("value")), "O").select("path", "entry")


@slice_of("SELECT c_custkey AS path, c_nationkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def stranded_bindings(read):
    """Customers as bindings without any use left: large orders are uses."""
    used = read("orders").where("o_totalprice > 300000").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("name"))
    return agreement.stranded(read("customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("name")), used)


@slice_of("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_linestatus = 'O' WHEN 'R' THEN l_linestatus <> 'O' END AS holds FROM lineitem""")
def judged_assertions(read):
    """What an assertion on a literal says: true, false or unknown."""
    expect = F.when(F.col("l_returnflag") == "A", "toBe(true)").when(F.col("l_returnflag") == "R", "toBeFalsy").otherwise("toResemble")
    return read("lineitem").select("l_orderkey", "l_linenumber", agreement.judge(expect, F.col("l_linestatus") == "O").alias("holds"))


@slice_of("""SELECT l_orderkey AS flag, string_agg(DISTINCT l_linenumber || ':' || l_shipmode_, ',' ORDER BY l_linenumber || ':' || l_shipmode_) AS reasons FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) WHERE l_discount > 0.09 GROUP BY l_orderkey""")
def refused_flags(read):
    """Orders any of whose lines was refused, with lines and reasons."""
    rows = read("lineitem").select(F.col("l_orderkey").alias("flag"), F.col("l_linenumber").cast("string").alias("path"), F.when(F.col("l_discount") > 0.09, F.col("l_returnflag")).alias("reason"))
    return agreement.refused_flags(rows).select("flag", F.array_join(F.transform("refusal_reasons", lambda r: F.concat(r["file"], F.lit(":"), r["reason"])), ",").alias("reasons"))


@slice_of("SELECT o_orderkey AS path FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def changed_files(read):
    """Files whose bytes differ between two snapshots, or that only one has."""
    before = read("orders").select(F.col("o_orderkey").alias("path"), F.concat("o_orderstatus", "o_orderpriority").alias("content"), "o_orderstatus", "o_orderpriority")
    after = before.where("o_orderpriority <> '5-LOW'").withColumn("content", F.when(F.col("o_orderstatus") == "P", "new").otherwise(F.col("content")))
    return remove.restored(before, after)


@slice_of("""SELECT p_partkey, regexp_full_match(k, '[a-z0-9]+([-_][a-z0-9]+)*') AS platform, regexp_full_match(k, '[A-Za-z0-9_]([A-Za-z0-9_.:-]*[A-Za-z0-9_])?') AS code, p_type = 'PROMO' OR p_type = 'promo' AS dead,
'Remove flag ' || k || ' (always ' || CASE WHEN p_size % 2 = 0 THEN 'on' ELSE 'off' END || ')' AS title FROM (SELECT *, replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE ' ' END) AS k FROM part)""")
def key_kinds(read):
    """Names of parts as keys: which a platform or a code search can have, and the titles of their removals."""
    k = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, ".").otherwise(" "))
    status = F.when(F.col("p_type") == "PROMO", "Dead").otherwise(F.col("p_type"))
    return read("part").select("p_partkey", keys.is_platform_key(k).alias("platform"), keys.is_code_key(k).alias("code"), tokens.is_dead(status).alias("dead"), keys.title(k, F.col("p_size") % 2 == 0).alias("title"))


@slice_of(r"""SELECT doc_id, regexp_matches(text, '(^|[^\pL\pN_.-])license([^\pL\pN_.-]|$)') AS dotted, regexp_matches(text, '(^|[^A-Za-z0-9_])(Apache|MIT)([^A-Za-z0-9_]|$)') AS any FROM documents""")
def key_tokens(read):
    """Keys bounded by anything but word characters, dots and dashes, and any of several identifiers."""
    t = F.col("text")
    return read("documents").select("doc_id", tokens.key_token(t, "license").alias("dotted"), tokens.mentions_any(t, ["Apache", "MIT"]).alias("any"))


@slice_of("SELECT event_id FROM (SELECT event_id, CAST(event_type = 'purchase' AND value > 20 OR event_type = 'error' AS INT) AS c, sum(CAST(event_type = 'purchase' AND value > 20 OR event_type = 'error' AS INT)) OVER (ORDER BY event_id) AS s FROM events) WHERE s - c < 300")
def proposals(read):
    """Results of a run that stops after 300 proposals: opened requests, and dry runs with a diff."""
    rows = read("events").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "pr-opened").when(F.col("event_type") == "purchase", "dry-run").otherwise("blocked").alias("action"), F.when(F.col("value") > 20, "d").otherwise("").alias("diff"))
    return candidates.up_to(rows, 300).select(F.col("seq").alias("event_id"))


@slice_of("""SELECT doc_id AS path, n.name, CAST(min(i) AS INT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), (VALUES ('Apache'), (' the ')) n(name) WHERE contains(t, n.name) GROUP BY ALL""")
def first_lines(read):
    """The first line of each document that holds each of two needles."""
    files = read("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    needles = files.select("path", F.explode(F.array(F.lit("Apache"), F.lit(" the "))).alias("name"))
    return mentions.first_lines(files, needles).select("path", "name", "line")


@slice_of("""SELECT event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND epoch_us(e.ts) // 1000000 >= epoch_us(o.ts) // 1000000 AND epoch_us(e.ts) // 1000000 < epoch_us(o.ts) // 1000000 + 120)""")
def point_outside_spans(read):
    """Purchases that no error precedes by two minutes."""
    e = read("events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("all", F.lit(1))
    spans = e.where("event_type = 'error'").select("all", F.col("at").alias("s"), (F.col("at") + 120).alias("t"))
    return relational.outside(e.where("event_type = 'purchase'").select("all", "at", "event_id"), spans, "all", "at", "s", "t").select("event_id")


#: Shapes of reads, each with what is left where the flag served true and false; # stands for a number.
SHAPES = (
    ("if (isEnabled('k')) { a(#); } else { b(#); }", "a(#);", "b(#);"),
    ("for (const x of xs) if (isEnabled('k')) a(#); next();", "for (const x of xs) a(#); next();", "for (const x of xs) {} next();"),
    ("if (q) if (isEnabled('k')) { a(#); b(#); }", "if (q) { a(#); b(#); }", "if (q) {}"),
    ("while (q) if (!isEnabled('k')) a(#); next();", "while (q) {} next();", "while (q) a(#); next();"),
    ("if (c) { a(); } else if (isEnabled('k')) { b(#); } else { d(); }", "if (c) { a(); } else { b(#); }", "if (c) { a(); } else { d(); }"),
    ("const v = x ?? isEnabled('k') ? # : b;", "const v = x ?? true ? # : b;", "const v = x ?? false ? # : b;"),
    ("const v = isEnabled('k') ? a(#, 2) : b;", "const v = a(#, 2);", "const v = b;"),
    ("f(isEnabled('k') && y(#));", "f(y(#));", "f(false);"),
    ("f(isEnabled('k') || y(#));", "f(true);", "f(y(#));"),
    ("if (y && isEnabled('k') || z) { a(#); }", "if (y || z) { a(#); }", "if (z) { a(#); }"),
    ("function a() { const on = isEnabled('k'); return on; } function b() { return on; }", "function a() { return true; } function b() { return on; }", "function a() { return false; } function b() { return on; }"),
    ("const on = isEnabled('k'); f(on, #, { on: 1 });", "const on = true; f(on, #, { on: 1 });", "const on = false; f(on, #, { on: 1 });"),
    ("f(client?.isEnabled('k'), #);", "f(client?.isEnabled('k'), #);", "f(client?.isEnabled('k'), #);"),
    ("const isEnabled = (k) => false; f(isEnabled('k'), #);", "const isEnabled = (k) => false; f(isEnabled('k'), #);", "const isEnabled = (k) => false; f(isEnabled('k'), #);"),
    ("const t = `${f('}')} // k is on.`; f(isEnabled('k'), #);", "const t = `${f('}')} // k is on.`; f(true, #);", "const t = `${f('}')} // k is on.`; f(false, #);"),
    ("f(await flags.isEnabled('k') === false, #);", "f(false, #);", "f(true, #);"),
)


def _case(column: int) -> str:
    return "CASE o_orderkey % " + str(len(SHAPES)) + "".join(f" WHEN {k} THEN '" + x[column].replace("'", "''") + "'" for k, x in enumerate(SHAPES)) + " END"


@slice_of(f"SELECT o_orderkey, replace(CASE WHEN o_orderstatus = 'F' THEN {_case(1)} ELSE {_case(2)} END, '#', CAST(o_custkey AS VARCHAR)) AS after FROM orders")
def fold_shapes(read):
    """Every order as a file with one of the shapes, folded to what it served."""
    chosen = F.element_at(F.array(*(F.lit(x[0]) for x in SHAPES)), (F.col("o_orderkey") % len(SHAPES) + 1).cast("int"))
    rows = read("orders").select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), (F.col("o_orderstatus") == "F").alias("treatment"), F.col("o_orderkey").cast("string").alias("path"), F.lit("ts").alias("language"), F.replace(chosen, F.lit("#"), F.col("o_custkey").cast("string")).alias("before"))
    return remove.folded(rows, [Accessor("isEnabled")]).select(F.col("path").cast("long").alias("o_orderkey"), "after")


#: The same for languages whose statements end with lines: language, shape, and what is left; / stands for a line's end.
DIALECT_SHAPES = (
    ("go", "func f() int {/if isEnabled('k') && y(#) {/return 1/}/return 2/}", "func f() int {/if y(#) {/return 1/}/return 2/}", "func f() int {/return 2/}"),
    ("go", "func f() {/on := isEnabled('k')/g(on, #)/}", "func f() {/g(true, #)/}", "func f() {/g(false, #)/}"),
    ("go", "func f() {/if x(#) {/a()/} else if isEnabled('k') {/b()/} else {/c()/}/}", "func f() {/if x(#) {/a()/} else {/b()/}/}", "func f() {/if x(#) {/a()/} else {/c()/}/}"),
    ("kt", "val s = if (isEnabled('k')) # else g(#)", "val s = #", "val s = g(#)"),
    ("kt", "fun f() {/val on = flags.isEnabled('k')/if (!on) {/a(#)/}/b()/}", "fun f() {/b()/}", "fun f() {/a(#)/b()/}"),
    ("kt", "fun f() = g(isEnabled('k') ?: x, client?.isEnabled('k') ?: #)", "fun f() = g(true, client?.isEnabled('k') ?: #)", "fun f() = g(false, client?.isEnabled('k') ?: #)"),
    ("swift", "func f() -> Int {/guard isEnabled('k') else {/return #/}/return 2/}", "func f() -> Int {/return 2/}", "func f() -> Int {/return #/}"),
    ("swift", "if isEnabled('k'), y(#) {/a()/} else {/b()/}", "if y(#) {/a()/} else {/b()/}", "b()"),
    ("swift", "let x = try flags.isEnabled('k') ? # : b", "let x = #", "let x = b"),
)


def _dialect_case(column: int) -> str:
    return "CASE o_orderkey % " + str(len(DIALECT_SHAPES)) + "".join(f" WHEN {k} THEN '" + x[column].replace("'", "''") + "'" for k, x in enumerate(DIALECT_SHAPES)) + " END"


@slice_of(f"SELECT o_orderkey, replace(replace(replace(CASE WHEN o_orderstatus = 'F' THEN {_dialect_case(2)} ELSE {_dialect_case(3)} END, '#', CAST(o_custkey AS VARCHAR)), '/', chr(10)), chr(39), chr(34)) AS after FROM orders")
def fold_dialects(read):
    """Every order as a file of Go, Kotlin or Swift, folded to what it served."""
    at = (F.col("o_orderkey") % len(DIALECT_SHAPES) + 1).cast("int")
    languages, shapes = (F.element_at(F.array(*(F.lit(x[k]) for x in DIALECT_SHAPES)), at) for k in (0, 1))
    before = F.translate(F.replace(shapes, F.lit("#"), F.col("o_custkey").cast("string")), "/'", '\n"')
    rows = read("orders").select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), (F.col("o_orderstatus") == "F").alias("treatment"), F.col("o_orderkey").cast("string").alias("path"), languages.alias("language"), before.alias("before"))
    return remove.folded(rows, [Accessor("isEnabled")]).select(F.col("path").cast("long").alias("o_orderkey"), "after")


#: Conditionals, blocks and loops: language, shape, and what is left where the flag served true and false (null: refused, so the file stays); ~ stands for a line's end.
CONDITIONALS = (
    *((x, f'{head}x = isEnabled("k") ? a(#) : b ? c : d;', f"{head}x = a(#);", f"{head}x = b ? c : d;") for x, head in (("ts", "const "), ("js", "const "), ("java", "int "), ("csharp", "var "), ("dart", "final "))),
    ("swift", 'let x = isEnabled("k") ? a(#) : b ? c : d~', "let x = a(#)~", "let x = b ? c : d~"),
    ("tsx", 'const p = <p>{isEnabled("k") ? a(#) : b ? c : d}</p>;', "const p = <p>{a(#)}</p>;", "const p = <p>{b ? c : d}</p>;"),
    ("ts", 'f(q ? isEnabled("k") ? a : b ? c : d : #);', "f(q ? a : #);", "f(q ? b ? c : d : #);"),
    ("ts", 'const f = () => isEnabled("k") ? { a: # } : null;', "const f = () => ({ a: # });", "const f = () => null;"),
    ("ts", 'const f = () => isEnabled("k") && { a: # };', "const f = () => ({ a: # });", "const f = () => false;"),
    ("ts", 'label: if (isEnabled("k")) { break label; } x(#);', "label: { break label; } x(#);", "label: {} x(#);"),
    ("ts", 'let x~if (isEnabled("k")) { x = # }~(function () {})()', "let x~x = #;~(function () {})()", "let x;~(function () {})()"),
    ("java", 'int f() { while (!isEnabled("k")) { a(#); } return 1; }', "int f() { return 1; }", "int f() { while (true) { a(#); } }"),
    ("java", 'int f() { while (isEnabled("k")) { for (;;) { break; } a(#); } return 1; }', "int f() { while (true) { for (;;) { break; } a(#); } }", "int f() { return 1; }"),
    ("csharp", 'int f() { while (isEnabled("k")) { if (q) break; a(#); } return 1; }', "int f() { while (true) { if (q) break; a(#); } return 1; }", "int f() { return 1; }"),
    ("csharp", 'var x = isEnabled("k") ? null : y(#);', None, "var x = y(#);"),
    ("dart", 'final a = [if (isEnabled("k")) a(#), b];', "final a = [a(#), b];", "final a = [b];"),
    ("dart", 'final a = [c, if (isEnabled("k")) a else d(#)];', "final a = [c, a];", "final a = [c, d(#)];"),
    ("python", 'def f():~    if isEnabled("k"):~        x = #~    else:~        yield 2~', None, "def f():~    yield 2~"),
    ("python", 'def f():~    if not isEnabled("k"):~        global G~    G = #~', None, "def f():~    global G~    G = #~"),
    ("python", 'if isEnabled("k"): pass~else: a(#)~', "pass~", "a(#)~"),
    ("python", 'x = [a for a in b(#) if isEnabled("k")]~', "x = [a for a in b(#)]~", "x = [a for a in b(#) if False]~"),
    ("ts", 'const s = `x${isEnabled("k") ? # : 2}y`;', "const s = `x${#}y`;", "const s = `x${2}y`;"),
    ("csharp", 'var s = $"a{f(isEnabled("k"), #)}b{{c}}";', 'var s = $"a{f(true, #)}b{{c}}";', 'var s = $"a{f(false, #)}b{{c}}";'),
    ("kt", 'val s = "a${if (isEnabled("k")) # else 2}b"~', 'val s = "a${#}b"~', 'val s = "a${2}b"~'),
)


def _shape_case(rows: tuple, column: int, at: str = "o_orderkey") -> str:
    said = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return f"CASE {at} % {len(rows)}" + "".join(f" WHEN {k} THEN {said(x[column])}" for k, x in enumerate(rows)) + " END"


def _shape(rows: tuple, column: int, at: str = "o_orderkey"):
    return F.element_at(F.array(*(F.lit(x[column]) for x in rows)), (F.col(at) % len(rows) + 1).cast("int"))


@slice_of(f"""SELECT o_orderkey, replace(replace(coalesce(CASE WHEN o_orderstatus = 'F' THEN {_shape_case(CONDITIONALS, 2)} ELSE {_shape_case(CONDITIONALS, 3)} END, {_shape_case(CONDITIONALS, 1)}), '#', CAST(o_custkey AS VARCHAR)), '~', chr(10)) AS after,
o_orderstatus = 'F' AND {_shape_case(CONDITIONALS, 2)} IS NULL AS refused FROM orders""")
def fold_conditionals(read):
    """Every order as a file with a conditional, a block or a loop around a read, in nine languages, folded or refused."""
    before = F.translate(F.replace(_shape(CONDITIONALS, 1), F.lit("#"), F.col("o_custkey").cast("string")), "~", "\n")
    rows = read("orders").select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), (F.col("o_orderstatus") == "F").alias("treatment"), F.col("o_orderkey").cast("string").alias("path"), _shape(CONDITIONALS, 0).alias("language"), before.alias("before"))
    return remove.folded(rows, [Accessor("isEnabled")]).select(F.col("path").cast("long").alias("o_orderkey"), "after", F.col("reason").isNotNull().alias("refused"))


#: Sources with the number of their syntax errors; -1: brackets don't match.
ERRONEOUS = (
    ("ts", "const x = a ? b : c ? d : #;", 0), ("ts", "const x = a : #;", 1), ("ts", "return a : #;", 1), ("ts", "f(a : #);", 1), ("ts", "const x = ;", 1), ("ts", "const x = a && ; f(#);", 1),
    ("ts", "if () { a(#); }", 1), ("ts", "if (a)", 1), ("ts", "else { b(#); }", 1), ("ts", "const f = (x: number, y?: string): Foo<Bar> => ({ a: #, b, ...c });", 0), ("ts", "const x = 1 2; a : b; const y = true false;", 2),
    ("ts", "do { a(#); }", 1), ("ts", "try { a(#); }", 1), ("ts", "const x = [a ? b];", 1), ("ts", "const o = { a: b : # };", 1), ("ts", "f(a, (b)", -1), ("tsx", "return <p a={b ? c : d}>{e ? <q/> : null} x {...f}</p>;", 0), ("tsx", "return <p>{a : b}</p>;", 1),
    ("java", "int f() { return a : #; }", 1), ("java", "Runnable r = () -> { a(#); }; Function<A, B> g = x -> x.y(); h(A::b);", 0), ("csharp", "var x = a : #;", 1), ("csharp", "var q = new Foo { A = 1, B = # }; var z = a?.b?[0] ?? c;", 0),
    ("dart", "final x = a : #;", 1), ("dart", "Widget f() { return Foo(a: 1, b: [if (x) y, for (var z in q) z, ...w], c: () => #); }", 0), ("go", "func f() {~if {~a()~}~}", 1), ("go", "func f() (int, error) {~if x, err := g(); err != nil {~return 0, err~}~return #, nil~}", 0),
    ("kt", "val x = a +", 1), ("kt", "fun f(a: Int?) = when (a) {~null -> 1~in 1..2, 3 -> #~else -> { h() }~}", 0), ("swift", "guard a { return }", 1), ("swift", "let y = a ? b : c ?? #~if let q = w, case .a(let r) = q { s() } else if t { u() }", 0),
)


@slice_of(f"SELECT o_orderkey, CAST({_shape_case(ERRONEOUS, 2)} AS INT) AS errors FROM orders")
def syntax_errors(read):
    """Every order as a source, right or wrong, with the number of its errors."""
    source = F.translate(F.replace(_shape(ERRONEOUS, 1), F.lit("#"), F.col("o_custkey").cast("string")), "~", "\n")
    return read("orders").select("o_orderkey", syntax.error_count(source, _shape(ERRONEOUS, 0)).alias("errors"))


#: Rewrites: language, source, result, and whether the gate lets it through.
REWRITES = (
    ("ts", "const x = q ? a(#) : b ? c : d;", "const x = a(#) : d;", False), ("ts", "const x = q ? a(#) : b;", "const x = a(#);", True), ("ts", "f(p ? q(#) : r);", "f(: r);", False), ("ts", "if (p) { a(#); } else { b(); }", "else { b(); }", False),
    ("ts", "const x = (1 2; f(#);", "const x = (1 2; f(true);", True), ("ts", "const x = 1 2; f(q(#));", "const x = 1 2; f(true);", True), ("java", "int f() { return p ? a : b ? c : #; }", "int f() { return a : #; }", False), ("python", "x = a if b(#) else c", "x = a if", False),
    ("kt", "val x = if (p) a else b(#)", "val x = else b(#)", False), ("swift", "guard p, q(#) else { return }", "guard else { return }", False), ("go", "func f() {~if p(#) {~a()~}~}", "func f() {~if {~a()~}~}", False), ("dart", "final a = [if (p) b, c(#)];", "final a = [c(#)];", True),
)


@slice_of(f"SELECT o_orderkey AS path FROM orders WHERE NOT CAST({_shape_case(REWRITES, 3)} AS BOOLEAN)")
def broken_rewrites(read):
    """Every order as a rewrite; those that are less well formed than their source."""
    put = lambda k: F.translate(F.replace(_shape(REWRITES, k), F.lit("#"), F.col("o_custkey").cast("string")), "~", "\n")
    return syntax.broken(read("orders").select(F.col("o_orderkey").alias("path"), _shape(REWRITES, 0).alias("language"), put(1).alias("before"), put(2).alias("after"))).select("path")


#: How a file uses another's constant: script, Python, and whether the use is the key of a read (null: it is none). # stands for the constant's number.
USES = (
    ("import { KEY# } from '../flags/c#';~f(isEnabled(KEY#));~", "from flags.c# import KEY#~f(isEnabled(KEY#))~", True),
    ("import { KEY# as K } from '../flags/c#';~log(K.length);~", "from flags.c# import KEY# as K~log(K.upper())~", False),
    ("import { KEY# } from '../flags/c#';~export const f = (KEY#) => isEnabled(KEY#);~", "from flags.c# import KEY#~def f(KEY#):~    return isEnabled(KEY#)~", None),
    ("import * as all from '../flags/c#';~f(isEnabled(all.KEY#));~", "import flags.c# as all~f(isEnabled(all.KEY#))~", True),
)


@slice_of(f"""SELECT 'src/o' || o_orderkey || e AS path, 'flags/c' || c_custkey || e AS module, 'KEY' || c_custkey AS name, o_orderkey % 4 <> 1 AS removable
FROM orders JOIN (SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN '.ts' ELSE '.py' END AS e FROM customer) ON o_custkey = c_custkey WHERE o_orderkey % 4 <> 2""")
def key_references(read):
    """Customers as modules that declare a key's constant, orders as files that use it: each use, with the module that its name leads to."""
    ending = F.when(F.col("c_custkey") % 2 == 0, ".ts").otherwise(".py")
    customers = read("customer").select("c_custkey", ending.alias("ending"))
    declared = F.when(F.col("ending") == ".ts", "export const KEY# = 'k#';").otherwise("KEY# = 'k#'")
    modules = customers.select(F.concat(F.lit("flags/c"), "c_custkey", "ending").alias("path"), F.replace(declared, F.lit("#"), F.col("c_custkey").cast("string")).alias("content"))
    chosen = F.when(F.col("ending") == ".ts", _shape(USES, 0)).otherwise(_shape(USES, 1))
    readers = read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("src/o"), "o_orderkey", "ending").alias("path"), F.translate(F.replace(chosen, F.lit("#"), F.col("c_custkey").cast("string")), "~", "\n").alias("content"))
    files = modules.union(readers).withColumn("language", checkout.language(F.col("path")))
    found = symbols.key_tables(relational.checkpointed(symbols.symbols(files, [Accessor("isEnabled")])), files)["references"]
    return found.select("path", "module", "name", "removable")


#: The modules of a flag: a key's constant, and wrappers around it. # stands for the flag's number.
CHAIN = (
    ("a", "export const KEY# = 'n#';~"), ("b", "import { KEY# } from './a';~export function first#() { return isEnabled(KEY#); }~"), ("c", "import { first# } from './b';~export const second# = () => !first#();~"),
    ("d", "import { second# } from './c';~export const third#: boolean = second#();~"), ("e", "import { third# } from './d';~export function fourth#(): boolean { return third#; }~"),
)


@slice_of("""SELECT 'c' || c_custkey || '.ts' AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'log(''off'');' ELSE 'log(' || c_custkey || ');' END AS after FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'n' || n_nationkey || '/' || m || '.ts', '' FROM nation, (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) v(m) WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def wrapper_chain(read):
    """Nations as flags, each with a constant and four wrappers over five modules; customers as files that call the last. All of it folds, and the modules are left empty."""
    number = F.col("n_nationkey").cast("string")
    modules = read("nation").join(read("customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey").select(number.alias("n"), F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(x).alias("x")) for m, x in CHAIN))).alias("f"))
    callers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey", F.lit(".ts")).alias("path"), F.concat(F.lit("import { fourth"), number, F.lit(" } from './n"), number, F.lit("/e';\nlog(fourth"), number, F.lit("() ? "), "c_custkey", F.lit(" : 'off');\n")).alias("content"))
    files = relational.checkpointed(modules.select(F.concat(F.lit("n"), "n", F.lit("/"), "f.m", F.lit(".ts")).alias("path"), F.translate(F.replace(F.col("f.x"), F.lit("#"), F.col("n")), "~", "\n").alias("content")).union(callers))
    flags = read("nation").select(F.concat(F.lit("n"), number).alias("key"), F.concat(F.lit("n"), number).alias("code_key"), (F.col("n_nationkey") % 2 == 0).alias("treatment"))
    reads = [Accessor("isEnabled")]
    table = relational.checkpointed(symbols.symbols(files.withColumn("language", checkout.language(F.col("path"))), reads))
    return spread.followed(flags, remove.pairs(flags, files), files, table, reads).where("reason is null").select("path", F.trim(F.regexp_replace("after", r"\s+$", "")).alias("after"))


@slice_of("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 7 = 0 AS fixed, max(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS other, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT 'o' || o_orderkey || '.ts' AS path, 'import { show' || o_custkey || ' } from ''./f/c' || o_custkey || ''';' || chr(10) || 'log(show' || o_custkey || '(' || o_orderkey || CASE WHEN other = 1 THEN ', true' ELSE '' END || '));' AS after FROM o WHERE NOT fixed
UNION ALL SELECT DISTINCT 'f/c' || o_custkey || '.ts', 'export function show' || o_custkey || '(a: number) { return a; }' FROM o WHERE other = 0""")
def constant_parameters(read):
    """Customers as modules with a function, orders as files that call it with a read of a flag, or (every seventh) with a literal that disagrees: both sides of the calls that agree are rewritten."""
    c, o = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    calls = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    modules = calls.select(F.concat(F.lit("f/c"), c, F.lit(".ts")).alias("path"), F.concat(F.lit("export function show"), c, F.lit("(a: number, on: boolean) { return on ? a : 0; }\n")).alias("content")).distinct()
    argument = F.when(F.col("o_orderkey") % 7 == 0, "false").otherwise("isEnabled('k')")
    callers = calls.select(F.concat(F.lit("o"), o, F.lit(".ts")).alias("path"), F.concat(F.lit("import { show"), c, F.lit(" } from './f/c"), c, F.lit("';\nlog(show"), c, F.lit("("), o, F.lit(", "), argument, F.lit("));\n")).alias("content"))
    files = relational.checkpointed(modules.union(callers))
    flags = files.sparkSession.createDataFrame([("k", "k", True)], "key string, code_key string, treatment boolean")
    reads = [Accessor("isEnabled")]
    held = relational.checkpointed(parameters.read(files.withColumn("language", checkout.language(F.col("path"))), reads))
    return spread.followed(flags, remove.pairs(flags, files), files, held.select("path", F.inline("symbols")), reads, held=held).where("reason is null").select("path", F.trim(F.regexp_replace("after", r"\s+$", "")).alias("after"))


#: Files with a mention beside a read: the file, and the places of the block that goes where the flag served true and false, as the text that begins it and the text it ends with (null: none is predicted).
GUARDED = (
    ("if (!isEnabled('k')) { log(KEY, #); return; } f(KEY);", "{ log(KEY", "return; }", None, None),
    ("if (isEnabled('k')) { a(#); } else { log(KEY); }", "{ log(KEY", "(KEY); }", "{ a(", "#); }"),
    ("if (q && isEnabled('k')) { log(KEY, #); }", None, None, None, None),
    ("if ((isEnabled('k'))) { log(KEY, #); } g(KEYS, x.KEY);", None, None, "{ log(KEY", "#); }"),
)


@slice_of(f"""WITH f AS (SELECT o_orderkey, replace({_shape_case(GUARDED, 0)}, '#', CAST(o_custkey AS VARCHAR)) AS t, CASE WHEN o_orderstatus = 'F' THEN {_shape_case(GUARDED, 1)} ELSE {_shape_case(GUARDED, 3)} END AS a,
replace(CASE WHEN o_orderstatus = 'F' THEN {_shape_case(GUARDED, 2)} ELSE {_shape_case(GUARDED, 4)} END, '#', CAST(o_custkey AS VARCHAR)) AS z FROM orders), s AS (SELECT *, CAST(strpos(t, a) - 1 AS INT) AS s, CAST(strpos(t, z) - 1 + length(z) AS INT) AS e FROM f)
SELECT o_orderkey, s AS "start", e AS "end", s IS NOT NULL AS kept, len(regexp_extract_all(CASE WHEN s IS NULL THEN t ELSE substr(t, 1, s) || ' ' || substr(t, e + 1) END, '\\bKEY\\b')) AS reported FROM s""")
def dead_blocks(read):
    """Every order as a file with a guard: the block that the fold is predicted to delete, whether it did, and how many mentions of a name stand outside it."""
    before = F.replace(_shape(GUARDED, 0), F.lit("#"), F.col("o_custkey").cast("string"))
    rows = read("orders").select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), (F.col("o_orderstatus") == "F").alias("treatment"), F.col("o_orderkey").cast("string").alias("path"), F.lit("ts").alias("language"), before.alias("before"))
    rows, reads = relational.checkpointed(rows), [Accessor("isEnabled")]
    found = relational.checkpointed(predicted.spans(rows, reads))
    lost = predicted.unkept(found, remove.folded(rows, reads)).select("path", F.lit(False).alias("ok"))
    outside = predicted.reported(rows, found, F.lit("KEY")).groupBy("path").agg(F.count("*").alias("reported"))
    out = rows.select("path").join(found.drop("flag"), "path", "left").join(lost, "path", "left").join(outside, "path", "left")
    return out.select(F.col("path").cast("long").alias("o_orderkey"), "start", "end", (F.col("start").isNotNull() & F.coalesce("ok", F.lit(True))).alias("kept"), F.coalesce("reported", F.lit(0)).cast("long").alias("reported"))

"""Event files: merged requests, commands in comments, deployments. JSON by a declared schema; nothing is guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.archive import command

# The payload fields that are read.
MERGE = "action string, pull_request struct<merged:boolean, number:int, html_url:string, merge_commit_sha:string, head:struct<ref:string>, base:struct<ref:string>>"
COMMENT = "action string, issue struct<number:int, pull_request:struct<url:string>>, comment struct<id:long, body:string, author_association:string>"
DEPLOYMENT = "deployment struct<environment:string, sha:string>, deployment_status struct<id:long, state:string, environment:string>"


def merged_requests(raw: DataFrame, body: str = "value") -> DataFrame:
    """branch, base, pull_request, url, merge_commit_sha and key of each merged removal; other events, and branches that aren't removals, give no row."""
    p = raw.select(F.from_json(body, MERGE, {"mode": "PERMISSIVE"}).alias("e")).where("e.action = 'closed' and e.pull_request.merged").select("e.pull_request.*")
    rows = p.select(F.col("head.ref").alias("branch"), F.col("base.ref").alias("base"), F.col("number").alias("pull_request"), F.col("html_url").alias("url"), "merge_commit_sha")
    return rows.withColumn("key", keys.key_of_branch(F.col("branch"))).where("key is not null")


def commands(raw: DataFrame, body: str = "value") -> DataFrame:
    """pull_request, comment, author_association and command of each new comment that gives one on a request."""
    e = raw.select(F.from_json(body, COMMENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.action = 'created' and e.issue.pull_request is not null").select("e.*")
    return e.select(F.col("issue.number").alias("pull_request"), F.col("comment.id").alias("comment"), "comment.author_association", command(F.col("comment.body")).alias("command")).where("command is not null")


def deployments(raw: DataFrame, body: str = "value") -> DataFrame:
    """event_id, environment, state and sha of each deployment status; the status's environment wins over the deployment's."""
    e = raw.select(F.from_json(body, DEPLOYMENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.deployment_status is not null").select("e.*")
    environment = F.coalesce("deployment_status.environment", "deployment.environment")
    return e.select(F.col("deployment_status.id").alias("event_id"), environment.alias("environment"), F.col("deployment_status.state").alias("state"), F.col("deployment.sha").alias("sha"))

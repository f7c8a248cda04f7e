"""Nested replies to rows. A missing key or a wrong type gives null, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_ms_text
from ..sources.schemas import IDENTITY, PATH_ROW, ROUND_ROW


def follow_edges(replies: DataFrame) -> DataFrame:
    """(login, following_login) of parsed replies (data): following as they stand, followers the other way round."""
    user = replies.select("data.user.*")
    out = user.select("login", F.explode("following.edges").alias("e")).select("login", F.col("e.node.login").alias("following_login"))
    back = user.select("login", F.explode("followers.edges").alias("e")).select(F.col("e.node.login").alias("login"), F.col("login").alias("following_login"))
    return out.unionAll(back).where("login is not null and following_login is not null")


def connection_state(replies: DataFrame, name: str) -> DataFrame:
    """(login, total, last_cursor) of a connection of each reply: where the next page begins."""
    c = F.col(f"data.user.{name}")
    return replies.select(F.col("data.user.login").alias("login"), c["totalCount"].alias("total"), F.try_element_at(c["edges"], F.lit(-1))["cursor"].alias("last_cursor"))


def watch_edges(replies: DataFrame) -> DataFrame:
    """(login, repo_full_name); a null node gives no row (its cursor still counts in connection_state)."""
    got = replies.select(F.col("data.user.login").alias("login"), F.explode("data.user.watching.edges").alias("e"))
    return got.select("login", F.col("e.node.nameWithOwner").alias("repo_full_name")).where("repo_full_name is not null")


def tree_entries(replies: DataFrame) -> DataFrame:
    """Parent and child rows of trees; entries without object give no row; parent_path is not in a reply."""
    got = replies.select("*", F.explode("entries").alias("e")).where("e.object is not null")
    return got.select(
        F.col("repository.nameWithOwner").alias("repository"), F.col("oid").alias("parent_oid"), F.col("e.object.oid").alias("child_oid"), F.col("__typename").alias("parent_type"),
        F.lit(None).cast("string").alias("parent_path"), F.col("id").alias("parent_node_id"), F.col("e.type").alias("child_type"), F.col("e.name").alias("child_path"), F.col("e.object.id").alias("child_node_id"),
    )


def blobs(replies: DataFrame) -> DataFrame:
    """Flat blob records."""
    return replies.select(F.col("repository.nameWithOwner").alias("repository"), "oid", F.col("id").alias("node_id"), F.col("byteSize").alias("byte_size"), F.col("isBinary").alias("is_binary"), F.col("isTruncated").alias("is_truncated"), "text")


def comments(replies: DataFrame) -> DataFrame:
    """Comments on changed lines with their user's login."""
    return replies.select("id", "path", "commit_id", "body", "created_at", "updated_at", F.col("original_line"), "author_association", F.col("user.login").alias("user_login"))


def timeline(replies: DataFrame) -> DataFrame:
    """Timeline items with their position in the unfiltered list; null nodes are left out after numbering."""
    got = replies.select(F.col("id").alias("pullrequest_node"), "repo_full_name", F.posexplode("timelineItems.edges").alias("position", "e")).where("e.node is not null")
    return got.select("pullrequest_node", "repo_full_name", F.col("e.node.id").alias("timelineitem_node"), F.col("e.node.createdAt").alias("create_at"), F.col("e.node.typename").alias("typename"), F.col("position").cast("long").alias("position"), F.to_json("e.node").alias("origin"))


def changes_by_round(items: DataFrame, opens: str, change: str) -> DataFrame:
    """Each round (an item of type `opens`) with the changes that follow it, up to the next round of its pull request; none: '-1' and -1.

    Which changes follow a round is our own definition. Columns: ROUND_ROW. items: pullrequest_node, timelineitem_node, typename, position.
    """
    w = Window.partitionBy("pullrequest_node").orderBy("position")
    seen = items.where(F.col("typename").isin(opens, change)).withColumn("at", F.last(F.when(F.col("typename") == opens, F.col("position")), ignorenulls=True).over(w))
    rounds = seen.where(F.col("typename") == opens).select("pullrequest_node", F.col("timelineitem_node").alias("opened"), F.col("position").alias("at"))
    changes = seen.where(F.col("typename") == change).select("pullrequest_node", "at", F.col("timelineitem_node").alias("change_node"), F.col("position").alias("change_position"))
    got = rounds.join(changes, ["pullrequest_node", "at"], "left")
    return got.select("pullrequest_node", "opened", F.coalesce("change_node", F.lit("-1")), "at", F.coalesce("change_position", F.lit(-1)).cast("long")).toDF(*ROUND_ROW)


def reviewer_paths(replies: DataFrame, project: str) -> DataFrame:
    """Every reviewer with every file of a change; empty lists give no rows; commit_sha is null."""
    got = replies.select("changeNumber", "timestamp", F.explode("reviewers.name").alias("reviewer"), "filePaths").select("*", F.explode("filePaths.location").alias("file"))
    return got.select(F.lit(f"{project}/{project}"), "changeNumber", epoch_ms_text(F.col("timestamp")), "reviewer", F.lit(None).cast("string"), "file").toDF(*PATH_ROW)


def with_commit_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Training rows with the files of their commit (left, one row per file). Files of other commits are dropped first."""
    return rows.join(files.join(rows.select("commit_sha").distinct(), "commit_sha", "left_semi"), "commit_sha", "left")


def one_of_each(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of an entity without repeats of its identity key (IDENTITY); of repeats any one stays, as their other columns are read from the same reply."""
    return rows.dropDuplicates(list(IDENTITY[kind]))


def request_files(requests: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(request, filename) once each: requests (request) with the files (commit, filename) of their commits (request, commit)."""
    return requests.select("request").join(commits.select("request", "commit"), "request").join(files.select("commit", "filename"), "commit").select("request", "filename").distinct()


def report_values(cells: DataFrame, cid: str = "whole", most: int = 12) -> DataFrame:
    """(sheet, period, modularity, entropy, top1, top3, top5) of report sheets (sheet, row_idx, c0 ... c6): blocks of 18 rows.

    Row 2 of a block is the header of the community figures in row 3 (c1 names the community, c4 and c5 hold
    modularity and entropy), row 4 that of the accuracies in row 6 (c2, c4, c6). Blocks without figures of the
    community cid are left out; `most` blocks of a sheet count at most.
    """
    at = F.col("row_idx") % 18
    value = lambda cond, c, name: F.max(F.when(cond, F.col(c))).cast("double").alias(name)
    whole = (at == 3) & (F.col("c1") == cid)
    got = cells.groupBy("sheet", F.floor(F.col("row_idx") / 18).alias("period")).agg(
        value(whole, "c4", "modularity"), value(whole, "c5", "entropy"), *[value(at == 6, c, n) for c, n in (("c2", "top1"), ("c4", "top3"), ("c6", "top5"))]
    )
    return got.where(F.col("modularity").isNotNull() & (F.col("period") < most))

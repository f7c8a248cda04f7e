"""Schemas of landed data, and our names of what is derived from them."""

from __future__ import annotations

# Columns of the landed table of change requests; the hosting service's interface names them.
_LANDED = (
    "number state title user_login body created_at updated_at closed_at merged_at merge_commit_sha author_association merged comments "
    "review_comments commits additions deletions changed_files head_label base_label"
)
#: (landed name, our alias): the alias is the name with a prefix, but for the id and the author
PULL_REQUEST = [(n, {"number": "pr_id", "user_login": "pr_author"}.get(n, f"pr_{n}")) for n in _LANDED.split()]
#: the landed column that names a project
PROJECT = "repo_full_name"

# Keys of landed JSON replies and headers of landed files.
COMMENT = "id long, path string, commit_id string, body string, created_at string, updated_at string, original_line long, author_association string, user struct<login:string,id:long>"
BLOB = "oid string, id string, isBinary boolean, isTruncated boolean, byteSize long, text string, repository struct<nameWithOwner:string>"
TREE = "repository struct<nameWithOwner:string>, __typename string, oid string, id string, entries array<struct<name:string,type:string,object:struct<id:string,oid:string>>>"
_LOGINS = "struct<totalCount:long,edges:array<struct<cursor:string,node:struct<login:string>>>>"
FOLLOW = f"data struct<user:struct<login:string,following:{_LOGINS},followers:{_LOGINS}>>"
WATCH = "data struct<user:struct<login:string,watching:struct<totalCount:long,edges:array<struct<cursor:string,node:struct<nameWithOwner:string>>>>>>"
TIMELINE = "id string, repo_full_name string, author struct<login:string>, timelineItems struct<edges:array<struct<node:struct<id:string,typename:string,createdAt:string>>>>"
CHANGE_DATASET = "changeNumber long, timestamp long, reviewers array<struct<name:string>>, filePaths array<struct<location:string>>"
CHANGE_FILE = "pull_number long, filename string"

#: rows of training files have no header: places are fixed, names are ours
TRAIN_ROW = (
    "reviewer string, request long, review long, commit string, author string, opened string, commits long, additions long, deletions long, head string, base string, "
    "reviewed string, changes long, added long, deleted long, files long, author_reviews long, author_pushes long, gap double"
)

#: our names of a reviewer's file row, and of rounds with the changes that follow them
PATH_ROW = ("project", "request", "opened", "reviewer", "commit", "file")
ROUND_ROW = ("request", "round", "change", "round_position", "change_position")
#: our names of the kinds of nodes and edges
NODE_KINDS = ("pr", "reviewer", "author")
EDGE_KINDS = ("pr-pr", "pr-reviewer", "pr-author", "author-reviewer", "reviewer-reviewer")
#: columns that tell the rows of an entity apart
IDENTITY = {
    "blob": ("repository", "oid"), "tree": ("repository", "parent_oid", "child_oid"), "round": ("request", "round", "change"),
    "follow": ("login", "following_login"), "watch": ("login", "repo_full_name"),
}

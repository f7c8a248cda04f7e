"""Scalar functions on paths, names, texts, times and 32-bit floats, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accounts that are bots although their names don't say so.
BOT_NAMES = [
    "stickler-ci", "codecov-io", "rails-bot", "mention-bot", "babel-bot", "symfony-skeleton-bot", "akka-ci", "buildsize",
    "stale", "netty-bot", "codecov", "label-actions", "salt-jenkins", "facebook-github-bot", "reactjs-bot", "pull-bot",
    "googlebot", "mary-poppins", "ngbot[bot]", "ngbot", "sklearn-lgtm", "pep8speaks", "fastlane-bot-helper", "netkins",
    "GordonTheTurtle", "lightbend-cla-validator", "sizebot", "angular-automatic-lock-bot", "codesandbox", "jenkins4kodi",
    "github-actions", "houndci-bot", "joomla-cms-bot", "CLAassistant", "claassistantio",
]
#: our own definition of the marker in bots' names
BOT_MARKER = "[bot]"


def path_prefixes(path: Column) -> Column:
    """Cumulative prefixes of a path, each with a leading slash; the full path is the last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text (null: none). Our own definition of a token."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def without_stop_words(words: Column, stop: list[str]) -> Column:
    """Words that are not in the stop list, repeats kept."""
    held = F.array(*[F.lit(w) for w in stop]).cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(held, w))


def is_bot(name: Column) -> Column:
    """True if the name holds the bot marker or is on the list; case counts."""
    return F.contains(name, F.lit(BOT_MARKER)) | name.isin(BOT_NAMES)


def epoch_ms_text(ms: Column) -> Column:
    """Epoch milliseconds as yyyy-MM-dd HH:mm:ss in the session's time zone, cut to the second."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd HH:mm:ss")


def float_mul(a: Column, b: Column) -> Column:
    """Product in 32 bits."""
    return a.cast("float") * b.cast("float")


def float_div(a: Column, b: Column) -> Column:
    """Quotient in 32 bits after IEEE 754: x/0 is an infinity, 0/0 is NaN."""
    x, y = a.cast("float"), b.cast("float")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    # the quotient of two 32-bit values in 64 bits, then rounded, is the 32-bit quotient
    return F.when(y == 0, by_zero).otherwise(x.cast("double") / F.when(y == 0, F.lit(1.0)).otherwise(y.cast("double"))).cast("float")


def strip_namespace(tag: Column) -> Column:
    """{ns}Tag -> tag."""
    return F.lower(F.regexp_replace(tag, r"^\{[^}]*\}", ""))


def add_structs(a: Column, b: Column, fields: list[str]) -> Column:
    """Arrays of structs added place by place and field by field, as a foreign function would on arrays of records."""
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[f] + y[f]).alias(f) for f in fields]))

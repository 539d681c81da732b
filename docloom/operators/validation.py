"""The gate for contributed documents: stages of checks, a rate limit, and what is published of an accepted request.

``requests``: request_id, op (submit, update, remove), ts, title, filePath, content, version, category, description,
contributorName, reason. Checks are column expressions that give an array of messages, empty if all is well.

Defined results for odd input: null counts as missing; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules, text
from docloom.operators.rates import rate_limit
from docloom.sources.scratch import stored

Message = tuple[Column, str | Column]


def _messages(*pairs: Message) -> Column:
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in pairs]))


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


#: Declared rules of raw JSON requests: field -> (required, least length, most length, allowed values, pattern).
REQUEST_SCHEMA = {
    "title": (True, *rules.TITLE, None, None),
    "filePath": (True, 1, None, None, rules.ALLOWED_PATH),
    "content": (True, *rules.CONTENT, None, None),
    "version": (True, None, None, ("v5", "v6"), None),
    "category": (False, None, None, tuple(rules.ALLOWED_CATEGORIES), None),
    "description": (False, None, None, None, None),
    "contributorName": (False, None, None, None, None),
}


def check_request_schema(raw: Column, schema: dict = REQUEST_SCHEMA) -> Column:
    """All breaches, as ``/field: what``, of a raw JSON request."""
    value = F.try_parse_json(raw)
    keys = F.json_object_keys(raw)
    pairs: list[Message] = []
    for name, (required, least, most, allowed, pattern) in schema.items():
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        there = F.array_contains(keys, name) & kind.isNotNull()
        is_text = there & (kind == "STRING")
        v = F.get_json_object(raw, f"$.{name}")
        if required:
            pairs.append((~there, f"/{name}: is required"))
        pairs.append((there & (kind != "STRING"), f"/{name}: must be string"))
        if least:
            pairs.append((is_text & (F.length(v) < least), f"/{name}: must have at least {least} characters"))
        if most:
            pairs.append((is_text & (F.length(v) > most), f"/{name}: must have at most {most} characters"))
        if allowed:
            pairs.append((is_text & ~v.isin(*allowed), f"/{name}: must be one of the allowed values"))
        if pattern:
            pairs.append((is_text & ~v.rlike(pattern), f"/{name}: must match the pattern"))
    known = F.array(*[F.lit(x) for x in schema])
    more = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("/"), k, F.lit(": is not an allowed property")))
    return F.when(keys.isNull(), F.array(F.lit("/: must be object"))).otherwise(F.concat(_messages(*pairs), more))


def check_fields() -> Column:
    """Stage 1; a removal has a reason instead of title, content and category."""
    title, content, reason, category = (F.col(c) for c in ("title", "content", "reason", "category"))
    edit, remove = F.col("op") != "remove", F.col("op") == "remove"
    outside = lambda c, b: ~_missing(c) & ~F.length(c).between(*b)
    return _messages(
        (edit & _missing(title), "title is required and must be a string."),
        (edit & outside(title, rules.TITLE), "title must be between 10 and 120 characters."),
        (edit & _missing(content), "content is required and must be a string."),
        (edit & ~_missing(content) & (F.length(content) < rules.CONTENT[0]), "content must be at least 100 characters."),
        (edit & (F.length(content) > rules.CONTENT[1]), "content must not exceed 50,000 characters."),
        (remove & _missing(F.col("filePath")), "filePath is required and must be a string."),
        (~F.coalesce(F.col("version").isin("v5", "v6"), F.lit(False)), 'version must be "v5" or "v6".'),
        (edit & _missing(F.col("filePath")), "filePath is required and must be a string."),
        (edit & ~_missing(category) & ~category.isin(*rules.ALLOWED_CATEGORIES), "category is not allowed."),
        (remove & _missing(reason), "reason is required and must be a string."),
        (remove & outside(reason, rules.REASON), "reason must be between 10 and 500 characters."),
    )


def check_path() -> Column:
    """Stage 2: pattern, normal form, characters, version against prefix."""
    p, v = F.col("filePath"), F.col("version")
    # A normal form differs for an empty or "." segment, or ".." after a named segment or the root.
    odd = p.contains("//") | p.rlike(r"(^|/)\.(/|\z)") | p.rlike(r"(^/|[^/.][^/]*/|(^|/)\.[^/.][^/]*/|(^|/)\.\.[^/]+/)\.\.(/|\z)")
    mismatch = lambda x: F.concat(
        F.lit(f'Version mismatch: filePath targets {x}_docs but version field is "'), v, F.lit('".')
    )
    return _messages(
        (~p.rlike(rules.ALLOWED_PATH), "filePath must match pattern docs/(v5_docs|v6_docs)/.../*.md"),
        (odd, 'filePath contains disallowed path segments (e.g., ".." or ".").'),
        (p.contains("\0"), "filePath contains null bytes."),
        (p.contains("\\"), "filePath contains backslashes."),
        (p.contains("//"), "filePath contains double slashes."),
        *[(p.startswith(f"docs/{x}_docs/") & (v != x), mismatch(x)) for x in ("v5", "v6")],
    )


def sanitize_reasons(content: Column) -> Column:
    """Stage 3: why a text is rejected. The costly pattern runs only where its first word occurs."""
    data = F.lower(content).contains("data:") & content.rlike(r"(?i)data:[^;]+;base64,.{1024,}")
    return _messages(
        (content.rlike(r"(?i)<script[\s>]"), "Content contains <script> tags"),
        (content.rlike(r"(?i)</script>"), "Content contains </script> closing tags"),
        (content.rlike(r"(?i)<iframe[\s>]"), "Content contains <iframe> tags"),
        (content.rlike(r"(?i)javascript\s*:"), "Content contains javascript: URIs"),
        (data, "Content contains large base64 data URIs (>1KB)"),
        (content.rlike(r"(?i)</iframe>"), "Content contains </iframe> closing tags"),
    )


def sanitize_warnings(content: Column) -> Column:
    handlers = content.rlike(r"""(?i)on\w+\s*=\s*["'][^"']*["']""")
    return _messages((handlers, "Content may contain inline event handlers (e.g., onclick)"))


def lint_markdown(content: Column) -> Column:
    """Stage 4: a top heading, and enough prose besides fenced blocks."""
    prose = text.trimmed(F.regexp_replace(content, r"(?s)```.*?```", ""))
    return _messages(
        (~content.rlike(r"(?m)^#\s+.+"), "Markdown must contain at least one top-level heading (# Title)."),
        (F.length(prose) < 50, "Markdown content is too short after removing code blocks (min 50 chars of prose)."),
    )


def check_existence(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds ``path_exists``, by a join with the known paths; an update or removal of an unknown path fails stage 5."""
    known = paths.select(F.col("path").alias("filePath")).distinct().withColumn("path_exists", F.lit(True))
    return requests.join(known, "filePath", "left").withColumn("path_exists", F.coalesce("path_exists", F.lit(False)))


def stage_errors(requests: DataFrame) -> DataFrame:
    """Adds ``failed_stage`` (null if none) and ``errors``, those of the first stage that fails; needs path_exists."""
    edit = F.col("op") != "remove"
    none = F.array().cast("array<string>")
    content = F.coalesce("content", F.lit(""))
    gone = (F.col("op") != "submit") & ~F.col("path_exists")
    stages = [
        ("fields", check_fields()),
        ("path", check_path()),
        ("sanitize", F.when(edit, sanitize_reasons(content)).otherwise(none)),
        ("lint", F.when(edit, lint_markdown(content)).otherwise(none)),
        ("existence", _messages((gone, F.concat(F.lit('File "'), F.col("filePath"), F.lit('" does not exist.'))))),
    ]
    rows = requests.withColumns({f"_{n}": F.coalesce(c, none) for n, c in stages})
    failed = F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.lit(n)) for n, _ in stages])
    errors = F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n, _ in stages], none)
    return rows.withColumn("failed_stage", failed).withColumn("errors", errors).drop(*[f"_{n}" for n, _ in stages])


def validate_requests(requests: DataFrame, paths: DataFrame, seconds: float = rules.RATE_SECONDS) -> DataFrame:
    """All stages: ``failed_stage``, ``errors``, ``warnings``, ``isUpdate``, ``status``. One clock a tool and contributor.

    One row per row: each row is a request of its own, so of repeated rows the first that comes to the clock is accepted
    and the others are late; ids may be null or repeat. Verdicts are written once; only what the clock needs goes to it, and what comes
    back is the requests that are late.
    """
    judged = stage_errors(check_existence(requests, paths))
    judged = judged.withColumn("warnings", F.when(F.col("op") != "remove", sanitize_warnings(F.coalesce("content", F.lit(""))))).withColumn(
        "isUpdate", (F.col("op") == "update") | ((F.col("op") == "submit") & F.col("path_exists"))
    )
    # Repeated rows may change places: they are equal but for this number.
    tie = F.xxhash64("title", "filePath", F.xxhash64(F.coalesce("content", F.lit(""))))
    rows = stored(judged.withColumn("_tie", tie).withColumn("_request", F.monotonically_increasing_id()))
    clock = F.concat_ws("/", "op", F.coalesce("contributorName", F.lit("")))
    fine = rows.filter("failed_stage IS NULL").select("_request", clock.alias("_clock"), "ts", "request_id", "_tie")
    limited = rate_limit(fine, "_clock", "ts", ["request_id", "_tie"], seconds)
    late = limited.filter(~F.col("allowed")).select("_request", "wait_seconds")
    message = F.concat(F.lit("Rate limited. Please try again in "), F.col("wait_seconds"), F.lit(" seconds."))
    is_late = F.col("wait_seconds").isNotNull()
    return (
        rows.join(late, "_request", "left")
        .withColumn("errors", F.when(is_late, F.array(message)).otherwise(F.col("errors")))
        .withColumn("failed_stage", F.when(is_late, "rate").otherwise(F.col("failed_stage")))
        .withColumn("status", F.when(F.col("failed_stage").isNull(), "accepted").otherwise("rejected"))
        .drop("_request", "_tie", "wait_seconds")
    )


def contribution_manifest(accepted: DataFrame, at: Column) -> DataFrame:
    """Branch, commit message, title and body of each accepted request."""
    or_ = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    kind = F.when(F.col("isUpdate"), "Update to existing doc").otherwise("New documentation")
    body = F.concat_ws(
        "\n",
        F.lit("## Community Documentation Contribution\n"),
        F.concat(F.lit("**Contributor:** "), or_("contributorName", "Anonymous")),
        F.concat(F.lit("**Target version:** "), F.col("version")),
        F.concat(F.lit("**Category:** "), or_("category", "auto-detect")),
        F.concat(F.lit("**File:** `"), F.col("filePath"), F.lit("`")),
        F.concat(F.lit("**Type:** "), kind),
        F.lit("\n### Description"),
        or_("description", "No description provided."),
    )
    return accepted.select(
        "request_id",
        text.branch_name(F.col("title"), at).alias("branch"),
        F.concat(F.when(F.col("isUpdate"), "docs: update ").otherwise("docs: add "), F.col("filePath")).alias("commit_message"),
        F.concat(F.lit("docs: "), F.col("title")).alias("pr_title"),
        body.alias("pr_body"),
    )

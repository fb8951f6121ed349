"""Queries over text, identity, time and row-level measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from timesift.functions import fixed, identity, measures, text, timecode
from timesift.operators import payloads
from timesift.operators.keyed import with_previous
from timesift.plans import views
from timesift.plans.catalog import query, table
from timesift.plans.views import sql


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_norm(w: str) -> str:
    base = f"(CASE WHEN ends_with({w}, '''s') THEN {w}[:len({w}) - 2] ELSE {w} END)"
    return (f"(CASE WHEN len({base}) >= 4 AND regexp_matches({base}, '[^sui]s$') "
            f"THEN {base}[:len({base}) - 1] ELSE {base} END)")


def sql_tokens(expr: str) -> str:
    return (f"list_transform(list_filter(regexp_extract_all(lower({expr}), '[a-z0-9.'']+'), "
            f"lambda w: len(w) > 1 AND NOT list_contains({sql_list(fixed.STOPWORDS)}, w)), "
            f"lambda w: {sql_norm('w')})")


def sql_exact_tokens(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*'), lambda w: lower(w))"


def sql_numbers(expr: str) -> str:
    """RE2 has no look-behind: the character before a number is consumed instead."""
    spaced = f"regexp_replace({expr}, '%', '% ', 'g')"
    return (f"regexp_extract_all({spaced}, "
            r"'(?i)(?:^|[^\pL\pN_])([$€£]?\d[\d,.]*(?:%|x|ms|s|gb|mb|kb)?)', 1)")


def sql_stamp(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return (f"(CASE WHEN {s} // 60 < 10 THEN '0' ELSE '' END || CAST({s} // 60 AS VARCHAR) || ':' || "
            f"lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))")


def sql_hours(s: str) -> str:
    short = f"lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"
    return f"(CASE WHEN {s} >= 3600 THEN CAST({s} // 3600 AS VARCHAR) || ':' ELSE '' END || {short})"


@query("tokenize_norm", f"SELECT doc_id, array_to_string({sql_tokens('text')}, '|') AS tokens, "
       f"CAST(len({sql_tokens('text')}) AS BIGINT) AS n FROM documents")
def tokenize_norm(spark, sf):
    tokens = text.evidence_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.array_join("t", "|").alias("tokens"), F.size("t").cast("long").alias("n"))


@query("tokenize_exact", f"SELECT doc_id, array_to_string({sql_exact_tokens('text')}, '|') AS tokens FROM documents")
def tokenize_exact(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.exact_tokens(F.col("text")), "|").alias("tokens"))


@query("extract_numbers", f"SELECT doc_id, array_to_string({sql_numbers('text')}, '|') AS numbers FROM documents "
       f"WHERE len({sql_numbers('text')}) > 0")
def extract_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.numbers(F.col("text")).alias("n")).where(
        F.size("n") > 0).select("doc_id", F.array_join("n", "|").alias("numbers"))


@query("cue_flags", sql(r"""SELECT source_id, seg_idx,
  regexp_matches(text, '[$][0-9]|[0-9]+(\.[0-9]+)?%|per million|[0-9,]+ tokens|[0-9]+ (minutes?|seconds?)') AS has_number,
  regexp_matches(text, '(?i)as you can see|you can see|look at|on ?(the )?screen|right here|this is what|check (this |it )?out|shown here') AS deictic,
  regexp_matches(text, '(?i)summari|overview|main (stories|points|topics)|everything|all the') AS coverage
FROM v_segments""", "v_segments"))
def cue_flags(spark, sf):
    flags = text.cue_flags(F.col("text"))
    return views.segments(spark, sf).select(
        "source_id", "seg_idx", flags["numeric"].alias("has_number"), flags["deictic"].alias("deictic"),
        flags["coverage"].alias("coverage"))


@query("decode_markup")
def decode_markup(spark, sf):
    clean = text.decode_markup(text.strip_tags(F.col("html")))
    return table(spark, sf, "pages").select("page_id", clean.alias("text"), F.length(clean).cast("long").alias("n_chars"))


_DROPPED = (r"(regexp_matches(c, '[\p{Cf}\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}"
            r"\x{E0100}-\x{E01EF}\x{E0000}-\x{E007F}]') AND NOT (regexp_matches(c, '[\x{200C}\x{200D}]') "
            r"AND i > 1 AND i < len(chars) AND ord(chars[i - 1]) > 127 AND ord(chars[i + 1]) > 127))")


@query("strip_invisible", f"""WITH parts AS (SELECT page_id, string_split(html, '') AS chars FROM pages),
kept AS (SELECT page_id, chars, list_filter(chars, lambda c, i: NOT {_DROPPED}) AS good FROM parts)
SELECT page_id, array_to_string(good, '') AS text, CAST(len(chars) - len(good) AS BIGINT) AS removed FROM kept""")
def strip_invisible(spark, sf):
    clean = text.strip_invisible(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", clean.alias("text"), (F.length("html") - F.length(clean)).cast("long").alias("removed"))


# The documents hold no evidence marker, so the twin covers terminators, fences and invisible characters.
@query("sanitize_text", f"""WITH parts AS (SELECT doc_id, text, string_split(text, '') AS chars FROM documents),
kept AS (SELECT doc_id, text, array_to_string(list_filter(chars, lambda c, i: NOT {_DROPPED}), '') AS good FROM parts),
flat AS (SELECT doc_id, text, regexp_replace(good, '\\r\\n|[\\r\\x{{2028}}\\x{{2029}}\\f\\x{{85}}]', chr(10), 'g') AS good FROM kept),
woven AS (SELECT doc_id, text, array_to_string(list_transform(string_split(good, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*(```|~~~)') THEN chr(8203) || l ELSE l END), chr(10)) AS good FROM flat)
SELECT doc_id, good AS text, CAST(length(good) - length(text) AS BIGINT) AS added FROM woven""")
def sanitize_text(spark, sf):
    clean = text.sanitize(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", clean.alias("text"), (F.length(clean) - F.length("text")).cast("long").alias("added"))


@query("bounded_text", r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN body = '' THEN NULL WHEN length(body) > 2000 THEN
  regexp_replace(substr(body, 1, 2000), '\s+$', '') || chr(10) || chr(10) || '[… truncated at 2000 characters]'
  ELSE body END AS description FROM b""")
def bounded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.bounded_text(F.col("text")).alias("description"))


_REDACT_SQL = "text"
for _pattern, _new in (
    (r"(?i)(authorization|cookie|set-cookie)(\s*[:=]\s*)\S+", r"\1\2<redacted>"),
    (r"(https?://[^\s?#]*)[?#]\S*", r"\1<redacted-query>"),
    (r"""(?i)\b[A-Z]:\\(?:[^\s'"\\]+\\)+[^\s'"]*""", "<redacted-path>"),
    (r"""(^|[^\pL\pN_:])/(?:[^\s'"/]+/)+[^\s'"]*""", r"\1<redacted-path>"),
):
    _REDACT_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(_REDACT_SQL, _pattern.replace("'", "''"), _new)


@query("redact_text", f"SELECT doc_id, {_REDACT_SQL} AS text FROM documents")
def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("url_identity", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
  regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', '') AS place,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, lower(scheme) || '://' || lower(regexp_replace(place, ':\d*$', '')) ||
  CASE WHEN regexp_extract(place, ':(\d+)$', 1) = '' THEN '' ELSE ':' || regexp_extract(place, ':(\d+)$', 1) END || path AS public_url,
  regexp_matches(url, '^(?:https?|HTTPS?)://[^/?#]+') AS is_url FROM p)
SELECT page_id, public_url, sha256(public_url) AS identity, is_url FROM c""")
def url_identity(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", identity.public_url(url).alias("public_url"), identity.url_identity(url).alias("identity"),
        identity.is_url(url).alias("is_url"))


@query("content_identity", "SELECT doc_id, sha256(text) AS identity FROM documents")
def content_identity(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", identity.content_identity(F.encode("text", "UTF-8")).alias("identity"))


# Language lists are made from the document language and its identifier.
_LANG_SPEC = ("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN lang || '-us, EN-gb,' || lang || '-US' "
              "WHEN doc_id % 5 = 2 THEN 'auto' WHEN doc_id % 5 = 3 THEN lang || ',,' ELSE 'zh-hant-tw,' || lang END")
_SQL_RECASE = ("array_to_string(list_transform(string_split(t, '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p) "
               "WHEN len(p) = 2 THEN upper(p) WHEN len(p) = 4 THEN upper(p[1:1]) || lower(p[2:]) ELSE p END), '-')")


@query("language_tags", f"""WITH s AS (SELECT doc_id, {_LANG_SPEC} AS spec FROM documents),
p AS (SELECT doc_id, spec, list_transform(string_split(spec, ','), lambda x: trim(x)) AS parts FROM s),
v AS (SELECT doc_id, CASE WHEN spec IS NULL THEN ['en'] WHEN parts = ['auto'] THEN parts
  WHEN len(list_filter(parts, lambda x: x = 'auto' OR NOT regexp_full_match(x, '[A-Za-z]{{2,8}}(-[A-Za-z0-9]{{1,8}})*'))) > 0 THEN NULL
  ELSE list_transform(parts, lambda x: lower(x)) END AS tags FROM p),
d AS (SELECT doc_id, list_filter(tags, lambda x, i: list_position(tags, x) = i) AS tags FROM v)
SELECT doc_id, array_to_string(tags, ',') AS tags,
  array_to_string(list_transform(tags, lambda t: {_SQL_RECASE}), ',') AS recased FROM d""")
def language_tags(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", F.expr(_LANG_SPEC).alias("spec"))
    return base.select("doc_id", text.language_tags(F.col("spec")).alias("tags")).select(
        "doc_id", F.array_join("tags", ",").alias("tags"),
        F.array_join(F.transform("tags", text.recase_tag), ",").alias("recased"))


_WHOLE = "CAST(floor(t) AS BIGINT)"
_TIME_SPEC = ("CASE WHEN item_id % 4 = 0 THEN CAST({w} % 5000 AS {s}) WHEN item_id % 4 = 1 THEN "
              "concat(CAST({m} AS {s}), ':', CAST({w} % 90 AS {s}), '.5') WHEN item_id % 4 = 2 THEN "
              "concat(CAST({h} AS {s}), ':', CAST({w} % 60 AS {s}), ':', CAST({w} % 55 AS {s})) ELSE 'x:1' END")
_SPARK_SPEC = _TIME_SPEC.format(w=_WHOLE, s="STRING", m=f"floor({_WHOLE} % 4000 / 60)", h=f"floor({_WHOLE} % 80000 / 3600)")
_DUCK_SPEC = _TIME_SPEC.format(w=_WHOLE, s="VARCHAR", m=f"({_WHOLE} % 4000 // 60)", h=f"({_WHOLE} % 80000 // 3600)")


@query("parse_time", sql(f"""s AS (SELECT item_id, {_DUCK_SPEC} AS spec FROM v_points),
p AS (SELECT item_id, spec, string_split(spec, ':') AS x FROM s)
SELECT item_id, spec, CASE len(x) WHEN 1 THEN TRY_CAST(x[1] AS DOUBLE)
  WHEN 2 THEN TRY_CAST(x[1] AS BIGINT) * 60 + TRY_CAST(x[2] AS DOUBLE)
  ELSE TRY_CAST(x[1] AS BIGINT) * 3600 + TRY_CAST(x[2] AS BIGINT) * 60 + TRY_CAST(x[3] AS DOUBLE) END AS seconds,
  CASE WHEN TRY_CAST(x[1] AS DOUBLE) IS NULL OR (len(x) > 1 AND TRY_CAST(x[2] AS DOUBLE) >= 60)
    OR (len(x) > 2 AND TRY_CAST(x[3] AS DOUBLE) >= 60) THEN NULL ELSE
    list_reduce(list_transform(x, lambda v: TRY_CAST(v AS DOUBLE)), lambda a, b: a * 60 + b) END AS strict_seconds
FROM p""", "v_points"))
def parse_time(spark, sf):
    base = views.points(spark, sf).select("item_id", F.expr(_SPARK_SPEC).alias("spec"))
    return base.select("item_id", "spec", timecode.parse_time(F.col("spec")).alias("seconds"),
                       timecode.strict_seconds(F.col("spec")).alias("strict_seconds"))


@query("format_time", sql(f"""SELECT item_id, {sql_stamp('t')} AS minutes_form,
  {sql_hours('CAST(round_even(t, 0) AS BIGINT)')} AS clock_form,
  {sql_hours('CAST(floor(t) AS BIGINT)')} AS transcript_form FROM v_points""", "v_points"))
def format_time(spark, sf):
    t = F.col("t")
    return views.points(spark, sf).select(
        "item_id", timecode.minutes_stamp(t).alias("minutes_form"), timecode.clock(t).alias("clock_form"),
        timecode.transcript_stamp(t).alias("transcript_form"))


# Messages of a download tool, chosen by the event.
_MESSAGES = ["HTTP Error 429: Too Many Requests", "HTTP Error 403: Forbidden", "Private video", "read timed out",
             "Unsupported URL: x", "Requested format is not available", "sign in to confirm your age", "ok",
             "file is larger than max-filesize", "SABR streaming only", "strange end", "geo-restricted content"]
_MESSAGE = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"
_CLASS_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(message), '{s}')" for s in signs) + f" THEN '{name}'"
    for name, signs in fixed.FAILURE_SIGNS) + " WHEN exit_code <> 0 THEN 'unknown' END"


@query("classify_failure", f"""WITH m AS (SELECT event_id, event_type || ': ' || {_MESSAGE} AS message,
  CAST(user_id % 2 AS INT) AS exit_code, user_id % 7 = 0 AS timed_out, event_type <> 'view' AS has_output FROM events),
c AS (SELECT *, {_CLASS_SQL} AS failure_class FROM m)
SELECT event_id, failure_class, coalesce(failure_class IN {tuple(fixed.RETRYABLE_FAILURES)}, false) AS retryable,
  CASE WHEN timed_out OR exit_code = 124 THEN 'timeout' WHEN exit_code = 0 THEN 'success'
  WHEN NOT has_output THEN 'empty_output' ELSE 'failure' END AS exit_class FROM c""")
def classify_failure(spark, sf):
    base = table(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.lit(": "), F.expr(_MESSAGE)).alias("message"),
        (F.col("user_id") % 2).cast("int").alias("exit_code"), (F.col("user_id") % 7 == 0).alias("timed_out"),
        (F.col("event_type") != "view").alias("has_output"))
    found = text.classify_failure(F.col("message"), F.col("exit_code"))
    return base.withColumn("failure_class", found).select(
        "event_id", "failure_class",
        F.coalesce(F.col("failure_class").isin(list(fixed.RETRYABLE_FAILURES)), F.lit(False)).alias("retryable"),
        text.exit_class(F.col("exit_code"), F.col("timed_out"), F.col("has_output")).alias("exit_class"))


@query("question_policy", r"""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'coverage'
  WHEN regexp_matches(text, '(?i)summari|overview|main (stories|points|topics)|everything|all the') THEN 'coverage'
  ELSE 'targeted' END AS policy FROM conversations""")
def question_policy(spark, sf):
    asked = F.when(F.col("turn") % 5 == 4, "coverage").otherwise("auto")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.question_policy(F.col("text"), asked).alias("policy"))


_OBLIGATIONS_SQL = f"""array_to_string(list_filter(['answer',
  CASE WHEN len({sql_numbers('text')}) > 0 THEN 'exact-number' END,
  CASE WHEN list_has_any({sql_exact_tokens('text')}, {sql_list(fixed.NEGATION)}) THEN 'negation' END,
  CASE WHEN list_has_any({sql_exact_tokens('text')}, {sql_list(fixed.TEMPORAL)}) THEN 'before-state' END,
  CASE WHEN list_has_any({sql_exact_tokens('text')}, {sql_list(fixed.TEMPORAL)}) THEN 'after-state' END],
  lambda x: x IS NOT NULL), '|')"""


@query("obligations", f"SELECT conv_id, turn, {_OBLIGATIONS_SQL} AS obligations FROM conversations")
def obligations(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(text.obligations(F.col("text")), "|").alias("obligations"))


_ROUTE_SQL = {name: pattern.replace("(?iu)", "(?i)") for name, pattern in (
    ("visual", fixed.ROUTE_VISUAL), ("coverage", fixed.ROUTE_COVERAGE), ("said", fixed.ROUTE_SAID))}


@query("route_questions", f"""WITH r AS (SELECT conv_id, turn, text,
  CASE turn % 7 WHEN 6 THEN 'efficient' WHEN 5 THEN 'odd' END AS detail, CASE WHEN conv_id % 9 = 0 THEN '0:10,70' END AS stamps FROM conversations),
m AS (SELECT *, CASE WHEN detail IS NOT NULL THEN 1 WHEN stamps IS NOT NULL THEN 2
  WHEN regexp_matches(text, '{_ROUTE_SQL["visual"]}') THEN 3 WHEN regexp_matches(text, '{_ROUTE_SQL["coverage"]}') THEN 4
  WHEN regexp_matches(text, '{_ROUTE_SQL["said"]}') THEN 5 ELSE 6 END AS rule FROM r)
SELECT conv_id, turn, CAST(rule AS INT) AS rule, CASE WHEN rule = 1 THEN detail WHEN rule IN (2, 5) THEN 'transcript' ELSE 'balanced' END AS detail,
  CASE WHEN trim(text) = '' THEN 'question' WHEN detail = 'odd' THEN 'detail' END AS refusal FROM m""")
def route_questions(spark, sf):
    base = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text",
        F.when(F.col("turn") % 7 == 6, "efficient").when(F.col("turn") % 7 == 5, "odd").alias("asked"),
        F.when(F.col("conv_id") % 9 == 0, "0:10,70").alias("stamps"))
    rule = text.route_rule(F.col("text"), F.col("asked"), F.col("stamps"))
    refusal = F.when(F.trim("text") == "", "question").when(
        F.col("asked").isNotNull() & ~F.col("asked").isin(list(fixed.CONTROL_DETAILS)), "detail").when(
        F.col("stamps").isNotNull() & F.exists(
            F.split("stamps", ","), lambda s: timecode.strict_seconds(F.trim(s)).isNull()), "timestamps")
    return base.withColumn("rule", rule).select(
        "conv_id", "turn", "rule", text.route_detail(F.col("rule"), F.col("asked")).alias("detail"),
        refusal.alias("refusal"))


_SENTENCE_SQL = (r"list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？…‼⁇;；]+\s*'), lambda p: "
                 r"trim(regexp_replace(regexp_replace(lower(p), '[^\pL\pN_\s]', '', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '')")


@query("sentence_stream", sql(rf"""SELECT source_id, seg_idx, array_to_string({_SENTENCE_SQL}, '|') AS sentences
FROM v_segments WHERE NOT regexp_matches(text, '^\s*(?:[\[\(][^\]\)]*[\]\)]|[♪♫\s])+\s*$') AND len({_SENTENCE_SQL}) > 0""", "v_segments"))
def sentence_stream(spark, sf):
    return views.segments(spark, sf).select("source_id", "seg_idx", text.sentences(F.col("text")).alias("s")).where(
        F.size("s") > 0).select("source_id", "seg_idx", F.array_join("s", "|").alias("sentences"))


@query("canonical_hash", sql("""j AS (SELECT source_id, seg_idx, CAST(to_json({seg_idx: seg_idx, source_id: source_id, text: text}) AS VARCHAR) AS doc FROM v_segments)
SELECT source_id, seg_idx, sha256(doc) AS row_sha FROM j""", "v_segments"))
def canonical_hash(spark, sf):
    return views.segments(spark, sf).select("source_id", "seg_idx", identity.canonical_sha(
        source_id=F.col("source_id"), seg_idx=F.col("seg_idx"), text=F.col("text")).alias("row_sha"))


@query("ascii_hash", """WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: CASE WHEN ord(x) < 128 THEN x
  WHEN ord(x) < 65536 THEN '\\u' || lpad(lower(to_hex(ord(x))), 4, '0')
  ELSE '\\u' || lower(to_hex(55296 + (ord(x) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (ord(x) - 65536) % 1024)) END) AS parts FROM documents)
SELECT doc_id, sha256(array_to_string(parts, '')) AS ascii_sha FROM c""".replace("\\\\u", "\\u"))
def ascii_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(identity.ascii_json(F.col("text")), 256).alias("ascii_sha"))


_SECRET_RULES = {
    "secret_text": fixed.SECRET_TEXT,
    "token_value": r"(?i)\btoken\s*=\s*\S+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "home_path": fixed.HOME_PATH,
    "private_path": fixed.PRIVATE_PATH,
    "signed_url": fixed.SIGNED_URL,
}


@query("secret_scan", "SELECT doc_id, rule FROM (" + " UNION ALL ".join(
    "SELECT doc_id, '{}' AS rule FROM documents WHERE regexp_matches(text, '{}')".format(n, p.replace("'", "''"))
    for n, p in _SECRET_RULES.items()) + ")")
def secret_scan(spark, sf):
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in _SECRET_RULES.items()]))
    return table(spark, sf, "documents").select("doc_id", F.explode(hits).alias("rule"))


# Fields written as "name = value" stand in lists of one-field objects, links below their page. The built-in field names do
# not stand before such a sign in these texts, but "token" does.
_FIELD = r"(?:^|[ \n])([A-Za-z_]+) {0,3}[=:] {0,3}([^ \n]+)"
_FIELD_NAMES = fixed.SECRET_KEY + "|^token$"
_FIELD_TEXT = fixed.SECRET_TEXT + "|[0-9a-f]{40}"


@query("payload_scan", rf"""WITH f AS (SELECT doc_id, source, lang, regexp_extract_all(text, '{_FIELD}', 1) AS k, regexp_extract_all(text, '{_FIELD}', 2) AS v FROM documents),
p AS (SELECT concat('page ', page_id) AS payload_id, to_json({{page: {{url: url, links: list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: {{href: h}})}}}}) AS j FROM pages
  UNION ALL SELECT concat('doc ', doc_id), to_json({{meta: {{source: source, lang: lang}}, fields: list_transform(list_zip(k, v), lambda x: json_object(x[1], x[2]))}}) FROM f),
n AS (SELECT payload_id, 'payload' || replace(substr(t.fullkey, 2), '"', '') AS path, CASE WHEN t.fullkey <> '$' AND NOT suffix(t.fullkey, ']') THEN t.key END AS key,
  CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' END AS said FROM p, json_tree(p.j) t)
SELECT payload_id, path, 'secret-like field' AS rule FROM n WHERE regexp_matches(key, '{_FIELD_NAMES}')
UNION ALL SELECT payload_id, path, 'secret-like text' FROM n WHERE regexp_matches(said, '{_FIELD_TEXT}')
UNION ALL SELECT payload_id, path, 'absolute private path' FROM n WHERE regexp_matches(said, '^(?:/|~/|\\|[A-Za-z]:\S|(?i:file:))')
UNION ALL SELECT payload_id, path, 'non-canonical URL' FROM n WHERE contains(said, '://') AND (contains(said, '?') OR contains(said, '#'))""")
def payload_scan(spark, sf):
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.struct(h.alias("href")))
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("payload_id"),
        F.to_json(F.struct(F.struct("url", links.alias("links")).alias("page"))).alias("payload"))
    names, values = (F.regexp_extract_all("text", F.lit(_FIELD), F.lit(i)) for i in (1, 2))
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("payload_id"),
        F.to_json(F.struct(F.struct("source", "lang").alias("meta"),
                           F.zip_with(names, values, lambda k, v: F.create_map(k, v)).alias("fields"))).alias("payload"))
    return payloads.payload_violations(pages.unionByName(docs), _FIELD_NAMES, _FIELD_TEXT)


_PATH_SPEC = ("CASE WHEN page_id % 6 = 0 THEN concat('/', p) WHEN page_id % 6 = 1 THEN concat('a/../', p) "
              "WHEN page_id % 6 = 2 THEN concat('C:', p) WHEN page_id % 6 = 3 THEN concat(p, '/./x') ELSE p END")


@query("safe_path", rf"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/]*/([^?#]*)', 1) AS p FROM pages),
s AS (SELECT page_id, {_PATH_SPEC} AS path FROM u),
l AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM s)
SELECT page_id, path, path <> '' AND NOT contains(path, '\') AND NOT starts_with(path, '/')
  AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(parts) > 0 AND NOT list_contains(parts, '..')
  AND array_to_string(parts, '/') <> 'bundle.json' AS safe FROM l""")
def safe_path(spark, sf):
    base = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-zA-Z]+://[^/]*/([^?#]*)", 1).alias("p"))
    return base.select("page_id", F.expr(_PATH_SPEC).alias("path")).select(
        "page_id", "path", text.safe_relative_path(F.col("path")).alias("safe"))


@query("media_sniff", rf"""SELECT page_id, starts_with(html, 'GIF89a') OR starts_with(html, 'ID3') OR
  regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.({"|".join(fixed.MEDIA_SUFFIXES)})$') AS media FROM pages""")
def media_sniff(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.looks_like_media(
        F.encode("html", "UTF-8"), F.regexp_replace("url", "[?#].*$", "")).alias("media"))


@query("frame_stamp", sql("""n AS (SELECT source_id, idx, 'frame_' || lpad(CAST(idx AS VARCHAR), 4, '0') || '.jpg' AS name,
  CAST(round_even(ts * 61, 0) AS BIGINT) AS s FROM v_frames)
SELECT source_id, idx, regexp_replace(name, '\\.jpg$', '') || '_t' || CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE '' END
  || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's.jpg' AS stamped, name AS plain
FROM n""".replace("\\\\", "\\"), "v_frames"))
def frame_stamp(spark, sf):
    name = F.concat(F.lit("frame_"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".jpg"))
    stamped = timecode.stamped_name(name, F.col("ts") * 61)
    return views.frames(spark, sf).select("source_id", "idx", stamped.alias("stamped"),
                                          timecode.plain_name(stamped).alias("plain"))


@query("hash_similarity", sql("""h AS (SELECT source_id, seg_idx, sha256(lower(text)) AS a,
  sha256(lower(lag(text) OVER (PARTITION BY source_id ORDER BY seg_idx))) AS b FROM v_segments)
SELECT source_id, seg_idx, len(list_filter(range(0, 32), lambda i: substr(a, i * 2 + 1, 2) = substr(b, i * 2 + 1, 2))) / 32.0::DOUBLE AS similarity
FROM h WHERE b IS NOT NULL""", "v_segments"))
def hash_similarity(spark, sf):
    lines = views.segments(spark, sf).select("source_id", "seg_idx", identity.text_digest(F.col("text")).alias("digest"))
    paired = with_previous(lines, ["source_id"], "seg_idx", {"before": "digest"}, None)
    return paired.where("before is not null").select(
        "source_id", "seg_idx", identity.digest_similarity(F.col("digest"), F.col("before")).alias("similarity"))


def _frame_pairs(spark, sf):
    return with_previous(views.frames(spark, sf), ["source_id"], "idx", {"before": "thumb"}).where(
        "before is not null")


@query("frame_delta", sql("""p AS (SELECT source_id, idx, thumb, lag(thumb) OVER (PARTITION BY source_id ORDER BY idx) AS b FROM v_frames)
SELECT source_id, idx, round(list_sum(list_transform(thumb, lambda x, i: abs(x - b[i]))) / CAST(len(thumb) AS DOUBLE), 6) AS delta
FROM p WHERE b IS NOT NULL""", "v_frames"))
def frame_delta(spark, sf):
    return _frame_pairs(spark, sf).select(
        "source_id", "idx", F.round(measures.frame_delta(F.col("thumb"), F.col("before")), 6).alias("delta"))


@query("changed_cells", sql("""p AS (SELECT source_id, idx, list_concat(thumb, [0, 0]) AS a, list_concat(lag(thumb) OVER w, CASE WHEN lag(thumb) OVER w IS NOT NULL THEN [0, 0] END) AS b,
  lag(thumb) OVER w IS NOT NULL AS later FROM v_frames WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
d AS (SELECT source_id, idx, list_transform(a, lambda x, i: abs(x - b[i])) AS g FROM p WHERE later)
SELECT source_id, idx, round(len(list_filter(range(0, 22), lambda i: greatest(g[i * 3 + 1], g[i * 3 + 2], g[i * 3 + 3]) > 25)) * 100.0::DOUBLE / 22, 6) AS pct
FROM d""", "v_frames"))
def changed_cells(spark, sf):
    pair = _frame_pairs(spark, sf)
    last = F.array(F.lit(0), F.lit(0))  # 64 values: the 22nd cell is filled up with zeros
    pct = measures.changed_cell_pct(F.concat("thumb", last), F.concat("before", last))
    return pair.select("source_id", "idx", F.round(pct, 6).alias("pct"))


@query("visual_score", """SELECT event_id, round(0.55::DOUBLE * greatest(0, value - 5) + 0.25::DOUBLE * greatest(0, value - 20)
  + 0.20::DOUBLE * greatest(0, 10 - value) + CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END, 6) AS score FROM events""")
def visual_score(spark, sf):
    v = F.col("value")
    score = measures.visual_score(v - 5, 10 - v, v - 20, F.col("event_type") == "click")
    return table(spark, sf, "events").select("event_id", F.round(score, 6).alias("score"))


@query("sampling_budget", """WITH d AS (SELECT event_id, value * 20 AS dur, CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 8 END AS cap FROM events),
t AS (SELECT *, CASE WHEN dur <= 30 THEN least(cap, greatest(12, CAST(round_even(dur, 0) AS INT))) WHEN dur <= 60 THEN least(cap, 40)
  WHEN dur <= 180 THEN least(cap, 60) WHEN dur <= 600 THEN least(cap, 80) ELSE cap END AS target,
  CASE WHEN dur <= 5 THEN least(cap, greatest(10, CAST(round_even(dur * 6, 0) AS INT))) WHEN dur <= 15 THEN least(cap, greatest(30, CAST(round_even(dur * 4, 0) AS INT)))
  WHEN dur <= 30 THEN least(cap, 60) WHEN dur <= 60 THEN least(cap, 80) ELSE cap END AS focus FROM d WHERE dur > 0),
f AS (SELECT *, least(target / dur, 2.0::DOUBLE) AS fps, least(focus / dur, 2.0::DOUBLE) AS focus_fps FROM t)
SELECT event_id, round(fps, 6) AS fps, CAST(least(cap, greatest(1, CAST(round_even(fps * dur, 0) AS INT))) AS INT) AS frames,
  round(focus_fps, 6) AS focus_fps, CAST(least(cap, greatest(1, CAST(round_even(focus_fps * dur, 0) AS INT))) AS INT) AS focus_frames,
  round(least(8.0::DOUBLE, greatest(cap / dur, 0.001::DOUBLE)), 6) AS covered_fps FROM f""")
def sampling_budget(spark, sf):
    cap = F.when(F.col("user_id") % 3 == 0, 50).when(F.col("user_id") % 3 == 1, 100).otherwise(8)
    base = table(spark, sf, "events").select("event_id", (F.col("value") * 20).alias("dur"), cap.alias("cap")).where("dur > 0")
    dur, cap = F.col("dur"), F.col("cap")
    fps, frames = measures.bounded_fps(measures.auto_target(dur, cap) / dur, dur, cap)
    near, near_frames = measures.bounded_fps(measures.focus_target(dur, cap) / dur, dur, cap)
    return base.select(
        "event_id", F.round(fps, 6).alias("fps"), frames.alias("frames"), F.round(near, 6).alias("focus_fps"),
        near_frames.alias("focus_frames"),
        F.round(measures.coverage_fps(F.lit(8.0), dur, cap), 6).alias("covered_fps"))


@query("reader_budget", """SELECT doc_id, CAST(least(12, greatest(4, CAST(floor((25000 - CAST(floor(n_chars * 0.25::DOUBLE) AS BIGINT)) / 250.0::DOUBLE) AS BIGINT))) AS BIGINT) AS targeted_frames,
  CAST(least(32, greatest(4, CAST(floor((25000 - CAST(floor(n_chars * 9 * 0.25::DOUBLE) AS BIGINT)) / 250.0::DOUBLE) AS BIGINT))) AS BIGINT) AS coverage_frames FROM documents""")
def reader_budget(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", measures.reader_budget(n, F.lit(12)).cast("long").alias("targeted_frames"),
        measures.reader_budget(n * 9, F.lit(32)).cast("long").alias("coverage_frames"))


@query("judge_score", sql("""SELECT case_id, arm, round(sum(0.40::DOUBLE * correctness + 0.25::DOUBLE * completeness + 0.25::DOUBLE * citation + 0.10::DOUBLE * adherence), 6) AS total,
  count(*) AS judgments FROM v_judgments GROUP BY case_id, arm""", "v_judgments"))
def judge_score(spark, sf):
    score = measures.judge_score(*[F.col(c) for c in ("correctness", "completeness", "citation", "adherence")])
    return views.judgments(spark, sf).groupBy("case_id", "arm").agg(
        F.round(F.sum(score), 6).alias("total"), F.count(F.lit(1)).alias("judgments"))


@query("interval_iou", sql("""p AS (SELECT source_id, item_id, t AS a0, t + 600 * score AS a1, lead(t) OVER w AS b0, lead(t + 600 * score) OVER w AS b1
  FROM v_points WINDOW w AS (PARTITION BY source_id ORDER BY t, item_id))
SELECT source_id, item_id, round(CASE WHEN greatest(a1, b1) - least(a0, b0) > 0 THEN
  greatest(0.0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0 END, 6) AS iou FROM p WHERE b0 IS NOT NULL""", "v_points"))
def interval_iou(spark, sf):
    placed = indexed_points(spark, sf).withColumn("a1", F.col("t") + 600 * F.col("score"))
    paired = with_previous(placed, ["source_id"], "idx", {"b0": "t", "b1": "a1"}, ahead=True)
    return paired.where("b0 is not null").select("source_id", "item_id", F.round(measures.interval_iou(
        F.col("t"), F.col("a1"), F.col("b0"), F.col("b1")), 6).alias("iou"))


def indexed_points(spark, sf):
    from timesift.operators.keyed import row_index

    return row_index(views.points(spark, sf), ["source_id"], [F.col("t"), F.col("item_id")],
                     F.floor(F.col("t") / 3600))


@query("shift_segments", sql("""SELECT source_id, seg_idx, round(start_s + 12.5, 2) AS start_s, round(end_s + 12.5, 2) AS end_s,
  array_to_string(list_transform(string_split(text, ' '), lambda w, i: w || '@' || CAST(CAST(floor(start_s) AS BIGINT) + 12 + i - 1 AS VARCHAR)), ' ') AS words
FROM v_segments""", "v_segments"))
def shift_segments(spark, sf):
    from timesift.operators.segments import shift

    words = F.transform(F.split("text", " "), lambda w, i: F.struct(
        w.alias("word"), (F.floor("start_s") + i).cast("double").alias("start"),
        (F.floor("start_s") + i + 1).cast("double").alias("end")))
    moved = shift(views.segments(spark, sf).withColumn("words", words), F.lit(12.5))
    plain = F.transform("words", lambda w: F.concat(w["word"], F.lit("@"), F.floor(w["start"]).cast("string")))
    return moved.select("source_id", "seg_idx", "start_s", "end_s", F.array_join(plain, " ").alias("words"))


@query("question_rules", """WITH q AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 3 THEN 'odd' ELSE 'evidence' END AS detail,
  conv_id * 4000 AS budget, CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id * 300 END AS frames FROM conversations)
SELECT conv_id, turn, rule FROM (
 SELECT conv_id, turn, 'question exceeds 16 KiB' AS rule FROM q WHERE strlen(text) > 16384
 UNION ALL SELECT conv_id, turn, 'invalid detail' FROM q WHERE detail = 'odd'
 UNION ALL SELECT conv_id, turn, 'invalid text budget' FROM q WHERE budget NOT BETWEEN 1 AND 200000
 UNION ALL SELECT conv_id, turn, 'invalid frame budget' FROM q WHERE frames NOT BETWEEN 1 AND 10000)""")
def question_rules(spark, sf):
    from timesift.operators.quality import request_rules

    base = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit(1).alias("schema_version"), F.col("conv_id").cast("string").alias("source"),
        F.col("text").alias("question"), F.when(F.col("turn") % 4 == 3, "odd").otherwise("evidence").alias("detail"),
        (F.col("conv_id") * 4000).alias("text_budget"),
        F.when(F.col("turn") % 3 == 0, None).otherwise(F.col("conv_id") * 300).alias("max_frames"))
    return base.select("conv_id", "turn", F.explode(request_rules()).alias("rule"))


@query("token_cost", sql("""SELECT source_id, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) * 0.25::DOUBLE + 8 * 250, 6) AS estimated,
  round(sum(length(text)) / 3.6::DOUBLE + 8 * (512 * 288 / 750.0::DOUBLE), 6) AS published FROM v_segments GROUP BY source_id""", "v_segments"))
def token_cost(spark, sf):
    chars = F.col("chars")
    return views.segments(spark, sf).groupBy("source_id").agg(F.sum(F.length("text")).alias("chars")).select(
        "source_id", "chars", F.round(measures.estimated_tokens(chars, F.lit(8)), 6).alias("estimated"),
        F.round(measures.reported_tokens(chars, F.lit(512), F.lit(288), F.lit(8)), 6).alias("published"))


@query("arm_order", sql("""SELECT case_id, CASE WHEN (position(substr(sha256(CAST(case_id AS VARCHAR)), 2, 1) IN '0123456789abcdef') - 1) % 2 = 0
  THEN 'control' ELSE 'candidate' END AS first_arm FROM v_cases""", "v_cases"))
def arm_order(spark, sf):
    return views.cases(spark, sf).select(
        "case_id", identity.first_arm(F.col("case_id").cast("string")).alias("first_arm"))

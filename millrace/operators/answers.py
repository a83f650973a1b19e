"""Answers: suggestions, source lines and citations in generated Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import citation_text
from ..sources import views
from .retrieve import active_blocks

# The heading of suggestions, the mark of a source line, and the shape of a listed question.
HEADING = r"(?iu)^#{1,6}\s*[öo]nerilen\s+sorular\s*:?\s*$"
SOURCE = r"(?iu)^[*_]{0,2}kaynak[*_]{0,2}\s*:[*_]{0,2}\s*"
BULLET = r"^\s*(?:[-*+]\s+|\d+[\.)]\s+)(.+?)\s*$"


def _lines(markdown: Column) -> Column:
    return F.split(F.replace(F.coalesce(markdown, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")


def strip_fence(text: Column) -> Column:
    """What a leading code fence holds."""
    return F.when(
        F.trim(text).startswith("```"), F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*(\n|$)", ""), r"(?s)```(?!.*```).*$", "")
    ).otherwise(text)


def _heading_at(lines: Column) -> Column:
    """Place of the suggestions' heading from 1, 0 if there is none."""
    return F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(HEADING)), F.lit(True)).cast("int")


def suggestions(markdown: Column, limit: int = 4) -> Column:
    """Questions listed under the heading, without Markdown, the first of equals, 1 to 10 of them."""
    lines = _lines(markdown)
    at = _heading_at(lines)
    below = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: x.rlike(BULLET))
    bare = lambda x: F.btrim(
        F.regexp_replace(F.regexp_replace(F.regexp_extract(x, BULLET, 1), r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_~]", ""),
        F.lit(" \"'`-*"),
    )
    asked = F.filter(F.transform(below, bare), lambda x: x != "")
    keys = F.transform(asked, lambda x: F.upper(x))
    first = F.filter(asked, lambda x, i: F.array_position(keys, F.upper(x)) == i + 1)
    return F.when(at > 0, F.slice(first, 1, min(max(limit, 1), 10))).otherwise(F.array().cast("array<string>"))


def source_line(markdown: Column) -> Column:
    """What follows the mark in the last source line above the heading; null if there is none."""
    lines = _lines(markdown)
    at = _heading_at(lines)
    body = F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)
    found = F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: x.rlike(SOURCE))
    return F.btrim(F.regexp_replace(F.get(found, F.size(found) - 1), SOURCE, ""), F.lit(" *_"))


def body(markdown: Column) -> Column:
    """The answer above the heading without its last source line."""
    lines = _lines(markdown)
    at = _heading_at(lines)
    above = F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)
    is_source = F.transform(above, lambda x: F.trim(x).rlike(SOURCE))
    last = F.size(above) - F.array_position(F.reverse(is_source), F.lit(True)).cast("int")
    kept = F.when(F.array_contains(is_source, True), F.filter(above, lambda x, i: i != last)).otherwise(above)
    return F.trim(F.array_join(kept, "\n"))


def phone(number: Column) -> Column:
    """A number as + and digits: 00 is +, national forms get +90; null unless it has 7 to 15 digits."""
    digits = F.regexp_replace(number, r"\D", "")
    n = F.length(digits)
    after = lambda i: F.substring(digits, i + 1, 20)
    whole = (
        F.when(digits.startswith("00") & (n > 4), F.concat(F.lit("+"), after(2)))
        .when(F.contains(number, F.lit("+")), F.concat(F.lit("+"), digits))
        .when(digits.startswith("0") & (n == 11), F.concat(F.lit("+90"), after(1)))
        .when((n == 10) & F.left(digits, F.lit(1)).isin(*"23458"), F.concat(F.lit("+90"), digits))
        .when(digits.startswith("90") & (n == 12), F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )
    return F.when(n.between(7, 15), whole)


#: Letters of the part of a label by which lines that contain it are looked up.
GRAM = 6


def _contained(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """answer_id and key of the ``labels`` (key) that stand anywhere in the ``lines`` (answer_id, text).

    A label is looked up by the rarest of its parts of ``GRAM`` letters, so no
    line meets every label; shorter labels by all of theirs.
    """
    parts = lambda text, n: F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n))
    n = F.least(F.char_length("key"), F.lit(GRAM))
    grams = labels.where("key <> ''").select("key", F.explode(F.array_distinct(parts(F.col("key"), n))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("labels"))
    rarest = grams.join(common, "gram").groupBy("key").agg(F.min_by("gram", F.struct("labels", "gram")).alias("gram"))
    # lengths of the parts: at most GRAM numbers
    sizes = [r[0] for r in labels.where("key <> ''").select(n.alias("n")).distinct().collect()]
    long = lambda k: F.when(F.char_length("text") >= k, parts(F.col("text"), F.lit(k))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.flatten(F.array(*[long(k) for k in sizes]))) if sizes else F.array().cast("array<string>")
    near = lines.select("answer_id", "text", F.explode(found).alias("gram")).join(rarest, "gram")
    return near.where(F.contains("text", "key")).select("answer_id", "key")


def cite(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents that each answer's source line (answer_id, line) names, in order.

    First those whose whole label stands in the line, whatever separators it
    holds, the longest label first; then those of the cited pairs ``source -
    title; title | source - title``, taken apart and joined by key, in order of
    the line. Of blocks with equal labels that of the longest and then of the
    least id stands, and every document once.
    """
    keyed = blocks.select("document_id", "label", citation_text(F.upper("label")).alias("key"))
    order = F.struct(-F.char_length("label"), F.col("document_id"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("document_id", "label"), order).alias("_b")).select("key", "_b.*")
    lines = answers.where("line is not null").select("answer_id", citation_text(F.upper("line")).alias("text"))
    exact = _contained(lines, first.select("key")).select("answer_id", "key", F.lit(0).alias("g"), F.lit(0).alias("t"))
    groups = answers.select("answer_id", "line", F.posexplode(F.split("line", r"\s*\|\s*")).alias("g", "part"))
    named = groups.where(F.locate(" - ", "part") > 1).select(
        "answer_id", "g", F.substring_index("part", " - ", 1).alias("name"), F.expr("substring(part, locate(' - ', part) + 3)").alias("rest"),
    )
    titles = named.select("answer_id", "g", "name", F.posexplode(F.split("rest", r"\s*;\s*")).alias("t", "title"))
    pairs = titles.select("answer_id", citation_text(F.upper(F.concat_ws(" - ", "name", "title"))).alias("key"), F.col("g") + 1, F.col("t"))
    hits = exact.union(pairs).join(first, "key")
    long = F.when(F.col("g") == 0, -F.char_length("label")).otherwise(0)
    once = hits.groupBy("answer_id", "document_id").agg(F.min(F.struct(F.col("g") > 0, long, "g", "t")).alias("at"), F.first("label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("at", "document_id"))
    return once.select("answer_id", "document_id", "label", rank.alias("rank"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns in the form that answers have: body, source line, heading and suggestions."""
    said = views.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.col("conv_id")
    names = F.concat(
        F.lit("src"), n % 20, F.lit(" - src"), n % 20, F.lit(" en; src"), n % 20, F.lit(" de | src"), (n + 3) % 20, F.lit(" - src"), (n + 3) % 20, F.lit(" fr")
    )
    # marks of all kinds: plain, bold, after a line that a later one replaces, and none
    mark = {0: "Kaynak: ", 1: "**Kaynak:** ", 2: "kaynak: old - one\n_KAYNAK_ : ", 3: "Kaynaklar "}
    cited = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in mark.items() for x in kv]), n % 5 % 4), names)
    listed = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("- **"), s, F.lit("**"))), "\n")
    heading = F.when(n % 4 != 3, F.concat(F.lit("\n## Önerilen sorular\n"), listed)).otherwise("")
    contact = F.concat(F.lit("\nMail info."), n, F.lit("@mail.example.com or 0212 555 "), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" 11, www.site"), n, F.lit(".com/x."))
    return said.select((n * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", contact, F.lit("\n"), cited, heading).alias("markdown"))


def q_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir).select("answer_id", F.posexplode(suggestions(F.col("markdown"))).alias("position", "question"))
    return found


def q_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("markdown")
    return _answers(spark, sf_dir).select("answer_id", source_line(md).alias("line"), F.sha2(body(md), 256).alias("body_hash"))


def q_citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _answers(spark, sf_dir).select("answer_id", source_line(F.col("markdown")).alias("line"))
    return cite(lines, active_blocks(views.documents(spark, sf_dir), views.sources(spark, sf_dir)))


QUERIES = {
    "suggestions": q_suggestions,
    "source_lines": q_source_lines,
    "citation_resolution": q_citation_resolution,
}

_MARK = r"(?i)^[*_]{0,2}kaynak[*_]{0,2}\s*:[*_]{0,2}\s*"
_KEY = "trim(regexp_replace(regexp_replace(upper({}), '[^\\p{{L}}\\p{{Nd}}\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')"
_CONTACT = """chr(10) || 'Mail info.' || conv_id || '@mail.example.com or 0212 555 ' || lpad((conv_id % 100)::VARCHAR, 2, '0') || ' 11, www.site' || conv_id || '.com/x.'"""
_ANSWER = f"""answer AS (
  SELECT conv_id * 1000 + turn AS answer_id, text || {_CONTACT} || chr(10)
    || (['Kaynak: ', '**Kaynak:** ', 'kaynak: old - one' || chr(10) || '_KAYNAK_ : ', 'Kaynaklar '])[conv_id % 5 % 4 + 1]
    || 'src' || conv_id % 20 || ' - src' || conv_id % 20 || ' en; src' || conv_id % 20 || ' de | src' || (conv_id + 3) % 20 || ' - src' || (conv_id + 3) % 20 || ' fr'
    || CASE WHEN conv_id % 4 <> 3 THEN chr(10) || '## Önerilen sorular' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- **' || x || '**'), chr(10)) ELSE '' END AS markdown
  FROM conversations WHERE role = 'assistant'
), above AS (
  SELECT answer_id, CASE WHEN heading > 0 THEN lines[1:heading - 1] ELSE lines END AS lines FROM (
    SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(trim(x, ' '), '(?i)^#+ *[öo]nerilen +sorular *:? *$')), true), 0) AS heading
    FROM (SELECT answer_id, string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM answer))
), marked AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(trim(lines[i], ' '), '{_MARK}')) AS places FROM above
), line AS (
  SELECT answer_id, lines, places[-1] AS place, trim(regexp_replace(trim(lines[places[-1]], ' '), '{_MARK}', ''), ' *_') AS line FROM marked
)"""
ORACLES = {
    "suggestions": """
WITH listed AS (
  SELECT conv_id * 1000 + turn AS answer_id, i, trim(regexp_replace(trim(string_split(text, chr(10))[i]), '[*_~]', '', 'g'), ' "''`-*') AS q
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 3)
), firsts AS (
  SELECT * FROM listed WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY answer_id, upper(q) ORDER BY i) = 1)
SELECT answer_id, (k - 1)::INT AS position, q AS question
FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY i) AS k FROM firsts) WHERE k <= 4""",
    "source_lines": f"""
WITH {_ANSWER}
SELECT answer_id, line, sha256(trim(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: place IS NULL OR i <> place), lambda i: lines[i]), chr(10)), ' ')) AS body_hash
FROM line""",
    "citation_resolution": f"""
WITH label AS (
  SELECT min(d.id) AS document_id, s.name || ' - ' || d.title AS label FROM doc d JOIN src s ON s.id = d.source_id
  WHERE d.is_enabled AND NOT d.is_archived AND d.status_code = 'ok' AND s.is_enabled AND NOT s.is_archived
    AND length(trim(d.content, ' ')) > 0 GROUP BY s.name, d.title
), key AS (
  SELECT *, {_KEY.format("label")} AS key FROM label
), {_ANSWER}, part AS (
  SELECT answer_id, g, string_split_regex(line, '\\s*\\|\\s*')[g] AS part
  FROM (SELECT *, unnest(range(1, len(string_split_regex(line, '\\s*\\|\\s*')) + 1)) AS g FROM line)
), title AS (
  SELECT answer_id, g, t, split_part(part, ' - ', 1) || ' - ' || string_split_regex(substr(part, strpos(part, ' - ') + 3), '\\s*;\\s*')[t] AS cited
  FROM (SELECT *, unnest(range(1, len(string_split_regex(substr(part, strpos(part, ' - ') + 3), '\\s*;\\s*')) + 1)) AS t FROM part WHERE strpos(part, ' - ') > 1)
), hit AS (
  SELECT answer_id, document_id, label, [0, -length(label), 0, 0] AS place FROM line JOIN key ON contains({_KEY.format("line")}, key)
  UNION ALL SELECT answer_id, document_id, label, [1, 0, g, t] FROM title JOIN key ON {_KEY.format("cited")} = key
), once AS (
  SELECT answer_id, document_id, label, min(place) AS place FROM hit GROUP BY ALL
)
SELECT answer_id, document_id, label, row_number() OVER (PARTITION BY answer_id ORDER BY place, document_id)::INT AS rank FROM once""",
}

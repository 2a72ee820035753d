"""Queries over nested JSON: leaves, changes between results, canonical order and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.nested import canonical, digest, digest_text, leaf_changes, leaves
from strataloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT event_type, replace(fullkey[3:], '.', '/') AS path, count(*)::BIGINT AS n, min(atom::VARCHAR) AS least, max(atom::VARCHAR) AS most FROM (SELECT event_type, unnest(json_keys(props)) AS k, '$.' || k AS fullkey, json_extract(props, '$.' || k) AS atom FROM events) GROUP BY 1, 2")
def props_leaves(spark, sf_dir):
    """Leaves of ``events.props`` by type and path."""
    rows = leaves(table(spark, sf_dir, "events"), "props", "event_type")
    return rows.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT conv_id, 'turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']/' || k AS path, CASE k WHEN 'role' THEN '"' || role || '"' ELSE length(text)::VARCHAR END AS value
FROM (SELECT * FROM conversations), (VALUES ('role')) AS t(k) UNION ALL
SELECT conv_id, 'turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']/size/chars', length(text)::VARCHAR FROM conversations""")
def nested_leaves(spark, sf_dir):
    """Leaves of one nested JSON text a conversation."""
    turn = F.struct("turn", F.struct("role", F.struct(F.length("text").alias("chars")).alias("size")).alias("x"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["x"])
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("text"))
    return leaves(texts, "text", "conv_id")


def _profile(docs: DataFrame) -> DataFrame:
    """A nested result: one JSON text per source."""
    by_lang = docs.groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    langs = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("n", "chars"))))
    out = by_lang.groupBy("source").agg(F.sum("n").alias("files"), langs.alias("langs"))
    return out.select("source", F.to_json(F.struct("files", "langs")).alias("text"))


_LEAVES = """SELECT source, 'files' AS path, count(*) AS value FROM {0} GROUP BY 1 UNION ALL SELECT source, 'langs/' || coalesce(lang, 'none') || '/n', count(*) FROM {0} GROUP BY source, lang
UNION ALL SELECT source, 'langs/' || coalesce(lang, 'none') || '/chars', sum(n_chars) FROM {0} GROUP BY source, lang"""


@query(f"""WITH a AS ({_LEAVES.format('documents')}), k AS (SELECT * FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)), b AS ({_LEAVES.format('k')})
SELECT source, path, a.value::VARCHAR AS left_value, b.value::VARCHAR AS right_value FROM a FULL JOIN b USING (source, path) WHERE a.value IS DISTINCT FROM b.value""")
def result_changes(spark, sf_dir):
    """Leaves that differ between a nested result over all documents and over the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return leaf_changes(*(leaves(_profile(d), "text", "source") for d in (docs, labelled)), "source")


def _event_text() -> Column:
    """Each event as JSON with keys in no order, and a list in no order."""
    return F.concat(
        F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit(',"marks":["'), "event_type", F.lit('",'), F.col("event_id").cast("string"), F.lit(',{"b":null,"a":[]}]}')
    )


_CANONICAL = """SELECT event_type, '{"marks":[' || '"' || event_type || '",' || event_id || ',{"a":[],"b":null}],"props":{"k":' || json_extract(props, '$.k') || '},"user":' || user_id || '}' AS text FROM events"""


@query(f"SELECT event_type, text FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY text) AS place FROM ({_CANONICAL})) WHERE place <= 3")
def canonical_order(spark, sf_dir):
    """The first three events of each type, sorted by their canonical JSON."""
    rows = table(spark, sf_dir, "events").select("event_type", canonical(_event_text()).alias("text"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("text"))
    return rows.withColumn("place", place).filter("place <= 3").select("event_type", "text")


_QUARTERS = ", ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 15))::BIGINT)::HUGEINT AS q{i}" for i in range(4))


@query(f"""SELECT event_type, rows, sha256(rows || ':' || q0 || ':' || q1 || ':' || q2 || ':' || q3) AS digest FROM (
SELECT event_type, count(*)::BIGINT AS rows, {_QUARTERS} FROM (SELECT event_type, sha256('=' || text) AS h FROM ({_CANONICAL})) GROUP BY 1)""")
def table_digests(spark, sf_dir):
    """An order-free digest of the events of each type, in canonical form."""
    rows = table(spark, sf_dir, "events").select("event_type", canonical(_event_text()).alias("text"))
    return rows.groupBy("event_type").agg(*digest(F.col("text"))).select("event_type", "rows", digest_text().alias("digest"))

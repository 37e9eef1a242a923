"""Queries of phrases and classification over a whole dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import evidence as V
from goldweave.operators import phrases as P
from goldweave.plans.evidence import CUE_SQL
from goldweave.plans.registry import Tables, query

# Every document names a part of the catalogue, in a sentence by place, and some a brand beside it.
SAID_SQL = """SELECT d.doc_id, d.text || CASE d.doc_id % 5 WHEN 0 THEN ' We use the ' || p_name || ' in production.' WHEN 1 THEN ' We moved off ' || p_name || '! ' || p_brand || ' is next.' WHEN 2 THEN ' ' || p_name || ' vs others, on brand' || p_brand
  WHEN 3 THEN ' no' || p_name || 's here.' ELSE ' Please classify ' || p_name || '.' END AS t FROM documents d LEFT JOIN part ON p_partkey = d.doc_id % 150 + 1 WHERE d.text IS NOT NULL"""
BOUNDED = r"regexp_matches(lower({t}), '(^|[^\w])' || regexp_replace(lower({a}), '([^a-z0-9 ])', '\\\1', 'g') || '($|[^\w])')"


@query("c26b_phrases_of_a_dictionary", rf"""WITH d AS ({SAID_SQL}), a AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT doc_id, phrase FROM d JOIN a ON contains(lower(t), lower(phrase)) AND {BOUNDED.format(t='t', a='phrase')}""")
def c26b(t: Tables) -> DataFrame:
    phrases = t.part.select(F.explode(F.array("p_name", "p_brand", F.lower("p_type"))).alias("phrase"))
    return P.find(said(t), ["doc_id"], "t", phrases)


def said(t: Tables) -> DataFrame:
    t.documents.createOrReplaceTempView("documents")
    t.part.createOrReplaceTempView("part")
    return t.spark.sql(SAID_SQL)


def aliases(t: Tables) -> DataFrame:
    """A product is known by its two words and by the last of them; names that begin with s need another word beside them."""
    names = t.part.select("p_name").distinct()
    both = F.array(F.struct(F.lit(0).alias("place"), F.col("p_name").alias("alias")), F.struct(F.lit(1).alias("place"), F.element_at(F.split("p_name", " "), -1).alias("alias")))
    terms = F.when(F.col("product").startswith("s") & (F.col("place") == 0), F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("production")))
    return names.select(F.col("p_name").alias("product"), F.inline(both)).withColumn("co_terms", terms)


@query("k6b_classify_dictionary", rf"""WITH d AS (SELECT * FROM ({SAID_SQL}) WHERE {' AND '.join(f"NOT contains(lower(t), '{m}')" for m in V.INJECTION)}),
s AS (SELECT doc_id, t, trim(unnest(regexp_extract_all(t, '[^.!?\n]+[.!?]?'))) AS s, generate_subscripts(regexp_extract_all(t, '[^.!?\n]+[.!?]?'), 1) AS i FROM d),
a AS (SELECT p_name AS product, 0 AS place, p_name AS alias FROM part UNION SELECT p_name, 1, split_part(p_name, ' ', -1) FROM part),
n AS (SELECT s.doc_id, s.i, s.s, a.product, a.place FROM s JOIN a ON contains(lower(s.s), a.alias) AND {BOUNDED.format(t='s.s', a='a.alias')}
  WHERE NOT (a.product LIKE 's%' AND a.place = 0) OR {' OR '.join(BOUNDED.format(t='s.t', a=f"'{x}'") for x in ('Brand#1', 'Brand#2', 'production'))}),
k AS (SELECT *, CASE {CUE_SQL} ELSE 'mentions_only' END AS r FROM (SELECT *, ' ' || lower(s) || ' ' AS p FROM n)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, product ORDER BY CASE r WHEN 'vendor_or_partner' THEN 0 WHEN 'used_past' THEN 1 WHEN 'evaluating' THEN 2 WHEN 'uses_now' THEN 3 ELSE 4 END, place, i) AS rn FROM k)
SELECT doc_id, product, r AS relationship, s AS quote FROM o WHERE rn = 1""")
def k6b(t: Tables) -> DataFrame:
    return P.classify(said(t), ["doc_id"], "t", aliases(t))

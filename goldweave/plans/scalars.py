"""Queries of the scalar functions (normalisation, URLs, digests, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions import text as X
from goldweave.functions import urls as U
from goldweave.functions import values as V
from goldweave.plans.registry import Tables, query

# A customer's raw address: spaces, capitals, missing parts, role words, tags.
EMAIL_SQL = """CASE c_custkey % 6
  WHEN 0 THEN '  ' || c_name || '@' || c_mktsegment || '.Example.COM '
  WHEN 1 THEN 'Sales+' || CAST(c_custkey AS VARCHAR) || '@example.org'
  WHEN 2 THEN c_name
  WHEN 3 THEN '@example.net'
  WHEN 4 THEN c_name || '@'
  ELSE 'info@' || lower(c_mktsegment) || '.example.net' END"""
EMAIL = EMAIL_SQL.replace("VARCHAR", "STRING")


def contacts(t: Tables) -> DataFrame:
    return t.customer.withColumn("raw", F.expr(EMAIL))


@query("c2_untrusted_bound", """
SELECT doc_id, sha256(substr(text, 1, 4000)) AS value_sha, length(text) > 4000 AS truncated, length(text)::INTEGER AS original_length FROM documents""")
def c2(t: Tables) -> DataFrame:
    b = t.documents.select("doc_id", X.bounded(F.col("text")).alias("b"))
    return b.select("doc_id", F.sha2("b.value", 256).alias("value_sha"), "b.truncated", "b.original_length")


@query("c5_normalize_email", f"""
SELECT c_custkey, CASE WHEN strpos(e, '@') > 1 AND length(e) > strpos(e, '@') THEN e END AS email
FROM (SELECT c_custkey, lower(trim({EMAIL_SQL})) AS e FROM customer)""")
def c5(t: Tables) -> DataFrame:
    return contacts(t).select("c_custkey", X.normalize_email(F.col("raw")).alias("email"))


@query("c6_stated_email", f"""
WITH x AS (SELECT c_custkey, lower(trim(coalesce(CASE WHEN c_custkey % 4 = 0 THEN {EMAIL_SQL} END, 'bare' || CAST(c_custkey AS VARCHAR) || '@example.com'))) AS e FROM customer)
SELECT c_custkey, CASE WHEN strpos(e, '@') > 1 AND length(e) > strpos(e, '@') THEN e END AS email FROM x""")
def c6(t: Tables) -> DataFrame:
    personal = F.when(F.col("c_custkey") % 4 == 0, F.col("raw"))
    bare = F.concat(F.lit("bare"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return contacts(t).select("c_custkey", X.stated_email(personal, bare).alias("email"))


ROLE_SQL = "('" + "','".join(X.ROLE_WORDS) + "')"


@query("c7_role_address", f"""
WITH x AS (SELECT c_custkey, lower(trim({EMAIL_SQL})) AS e FROM customer)
SELECT c_custkey, coalesce(split_part(split_part(CASE WHEN strpos(e, '@') > 1 AND length(e) > strpos(e, '@') THEN e END, '@', 1), '+', 1) IN {ROLE_SQL}, false) AS is_role FROM x""")
def c7(t: Tables) -> DataFrame:
    return contacts(t).select("c_custkey", X.is_role_address(X.normalize_email(F.col("raw"))).alias("is_role"))


PROFILE_SQL = """CASE c_custkey % 5
  WHEN 0 THEN 'https://www.LinkedIn.com/in/' || c_mktsegment || '/?x=1#top'
  WHEN 1 THEN 'de.linkedin.com//in//' || c_mktsegment
  WHEN 2 THEN 'http://user@linkedin.com:443/in/a%20b' || CAST(c_custkey AS VARCHAR)
  WHEN 3 THEN 'https://linkedin.com/'
  ELSE '//Other.example./p/' || CAST(c_custkey AS VARCHAR) END"""


@query("c8_linkedin_url", """
SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN 'linkedin.com/in/' || lower(c_mktsegment)
  WHEN 1 THEN 'linkedin.com/in/' || lower(c_mktsegment)
  WHEN 2 THEN 'linkedin.com/in/a b' || CAST(c_custkey AS VARCHAR)
  WHEN 3 THEN NULL
  ELSE 'other.example/p/' || CAST(c_custkey AS VARCHAR) END AS profile FROM customer""")
def c8(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", U.linkedin_url(F.expr(PROFILE_SQL.replace("VARCHAR", "STRING"))).alias("profile"))


@query("c9_fold", """
SELECT c_custkey, lower(c_name) || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'strasse' ELSE 'fi 1' END AS folded FROM customer""")
def c9(t: Tables) -> DataFrame:
    odd = F.when(F.col("c_custkey") % 2 == 0, "  STRAßE ").otherwise(" ﬁ  ①")
    return t.customer.select("c_custkey", X.fold(F.concat_ws(" ", F.lit(" "), "c_name", odd)).alias("folded"))


@query("c10_person_name", """
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_name || '   Jr ' END AS f,
  CASE WHEN c_custkey % 4 <> 1 THEN 'Ann' END AS a, CASE WHEN c_custkey % 5 = 0 THEN 'Lo***e' ELSE c_mktsegment END AS b FROM customer),
y AS (SELECT c_custkey, lower(regexp_replace(trim(coalesce(f, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' ' || b END)), '\\s+', ' ', 'g')) AS n FROM x)
SELECT c_custkey, CASE WHEN strpos(n, '*') = 0 AND n <> '' THEN n END AS name FROM y""")
def c10(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    full = F.when(k % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit("   Jr ")))
    first = F.when(k % 4 != 1, F.lit("Ann"))
    last = F.when(k % 5 == 0, "Lo***e").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", X.person_name(full, first, last).alias("name"))


HOST_SQL = r"""regexp_extract(url, '^(?:[a-z]+:)?//([^/?#:]*)', 1)"""
DOMAIN_SQL = f"""CASE WHEN len(string_split({HOST_SQL}, '.')) >= 2 THEN array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') END"""


@query("c11_registrable_domain", f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def c11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.registrable_domain(U.host(F.col("url"))).alias("domain"))


# Names under suffixes of one, two and three labels, wildcards, exceptions, private suffixes and in punycode.
NAME_SQL = """CASE c_custkey % 9 WHEN 0 THEN 'WWW.shop' || k || '.co.uk' WHEN 1 THEN 'a.b' || k || '.github.io' WHEN 2 THEN 'm.x' || k || '.com' WHEN 3 THEN 'co.uk' WHEN 4 THEN 'a.b' || k || '.c.kawasaki.jp'
 WHEN 5 THEN 'q' || k || '.city.kawasaki.jp' WHEN 6 THEN 'www.ck' WHEN 7 THEN 'shop.xn--bcher-kva.example' ELSE '10.0.0.1' END"""


@query("c11b_suffix_rules", """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'shop' || c_custkey || '.co.uk' WHEN 1 THEN 'b' || c_custkey || '.github.io' WHEN 2 THEN 'x' || c_custkey || '.com' WHEN 4 THEN 'b' || c_custkey || '.c.kawasaki.jp'
 WHEN 5 THEN 'city.kawasaki.jp' WHEN 6 THEN 'www.ck' WHEN 7 THEN 'bücher.example' END AS domain FROM customer""")
def c11b(t: Tables) -> DataFrame:
    named = t.customer.select("c_custkey", F.expr(NAME_SQL.replace("|| k ||", "|| c_custkey ||")).alias("name"))
    return named.select("c_custkey", U.registrable_domain(F.col("name")).alias("domain"))


@query("c12_company_domains", f"""
SELECT page_id, array_to_string(list_sort(list_distinct([{DOMAIN_SQL}, 'example.co.uk'])), ',') AS domains FROM pages""")
def c12(t: Tables) -> DataFrame:
    names = F.array(U.host(F.col("url")), F.lit("shop.example.co.uk"), F.lit("GMAIL.com"), F.lit("10.0.0.1"))
    return t.pages.select("page_id", F.array_join(U.company_domains(names), ",").alias("domains"))


@query("c13_company_id", f"""
SELECT page_id, 'co-' || substr(sha256(array_to_string(list_sort(list_distinct([{DOMAIN_SQL}, 'zz.example'])), chr(31))), 1, 16) AS company_id FROM pages""")
def c13(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.company_id(F.array(U.url_host(F.col("url")), F.lit("zz.example"))).alias("company_id"))


@query("c14_content_sha", """
SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '"' || CASE WHEN o_orderstatus <> 'O' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}') AS sha FROM orders""")
def c14(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", V.content_sha(status=status, priority=F.col("o_orderpriority")).alias("sha"))


HMAC_PADS = tuple("".join(f"{b ^ x:02x}" for b in b"match-key".ljust(64, b"\0")) for x in (0x5C, 0x36))


@query("c15_match_key_digest", f"""
SELECT c_custkey, substr(sha256(from_hex('{HMAC_PADS[0]}') || from_hex(sha256(from_hex('{HMAC_PADS[1]}') || encode(c_name)))), 1, 16) AS digest FROM customer""")
def c15(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring(V.hmac_sha256(b"match-key", F.col("c_name")), 1, 16).alias("digest"))


FLAG_SQL = "CASE user_id % 9 WHEN 0 THEN ' No ' WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN 'yes' WHEN 5 THEN 'NaN' WHEN 6 THEN 'OFF' WHEN 7 THEN NULL ELSE event_type END"


@query("c16_flag_set", f"""
SELECT event_id, coalesce(lower(trim({FLAG_SQL})) NOT IN ('', 'no', 'false', '0', 'off', 'n', 'f', 'blank'), false) AS flagged FROM events""")
def c16(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.is_flag_set(F.expr(FLAG_SQL)).alias("flagged"))


@query("c17_url_dedupe_key", r"""
SELECT page_id, lower(regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^(?:[a-z]+:)?//[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS dedupe_key FROM pages""")
def c17(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.dedupe_key(F.col("url")).alias("dedupe_key"))


@query("c18_url_host", f"SELECT {DOMAIN_SQL} AS host, count(*) AS pages FROM pages GROUP BY 1")
def c18(t: Tables) -> DataFrame:
    return t.pages.groupBy(U.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("c19_names_domain", r"""
SELECT page_id, regexp_matches(lower(html), '(^|[^a-z0-9-])example\.com($|[^a-z0-9.-]|\.$|\.[^a-z0-9])') AS in_html,
  regexp_matches(lower(url), '(^|[^a-z0-9-])example\.com($|[^a-z0-9.-]|\.$|\.[^a-z0-9])') AS in_url FROM pages""")
def c19(t: Tables) -> DataFrame:
    d = F.lit("example.com")
    return t.pages.select("page_id", U.names_domain(F.col("html"), d).alias("in_html"), U.names_domain(F.col("url"), d).alias("in_url"))


@query("c20_attachment", f"""
SELECT page_id, CASE WHEN page_id % 7 = 0 OR {DOMAIN_SQL} IS NULL THEN 'unattached' WHEN {DOMAIN_SQL} = 'example.com' THEN 'own_domain'
  WHEN page_id % 3 = 0 THEN 'third_party_mention' ELSE 'unattached' END AS attachment FROM pages""")
def c20(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 7 != 0, F.col("url"))
    said = F.when(F.col("page_id") % 3 == 0, F.lit("See www.Example.com, now.")).otherwise(F.lit("notexample.com and example.com.evil.io"))
    return t.pages.select("page_id", U.attachment(url, [said], F.lit("example.com")).alias("attachment"))


@query("c21_signal_strength", """
WITH x AS (SELECT user_id, count(DISTINCT event_type) AS hosts, bool_or(event_type = 'signup') AS own, count(DISTINCT CASE WHEN value > 300 THEN event_type END) AS src FROM events GROUP BY 1)
SELECT user_id, CASE WHEN hosts >= 1 THEN [0.25::DOUBLE, 0.5, 0.75, 1.0][least(4, (CASE WHEN hosts >= 3 OR (own AND hosts >= 2) THEN 3 WHEN hosts >= 2 THEN 2 ELSE 1 END) + CASE WHEN src >= 2 THEN 1 ELSE 0 END)] END AS strength FROM x""")
def c21(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(
        F.count_distinct("event_type").alias("h"), F.bool_or(F.col("event_type") == "signup").alias("own"),
        F.count_distinct(F.when(F.col("value") > 300, F.col("event_type"))).alias("src"),
    )
    return per.select("user_id", U.signal_strength(F.col("h").cast("int"), F.col("own"), F.col("src")).alias("strength"))


@query("c25_sentences", r"""
SELECT doc_id, len(s)::INTEGER AS sentences, sha256(array_to_string(s, '|')) AS sha
FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def c25(t: Tables) -> DataFrame:
    s = X.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).alias("sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sha"))


@query("c26_phrase_match", """
SELECT doc_id, contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') AS has_phrase,
  contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' license ') OR contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' en de ') AS has_any FROM documents""")
def c26(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.has_phrase(F.col("text"), "of the").alias("has_phrase"), X.has_any_phrase(F.col("text"), ("license", "en-de")).alias("has_any"))


@query("c23_should_fetch", "SELECT page_id, strpos(lower(html), 'ering') > 0 OR strpos(lower(html), 'license') > 0 AS fetch FROM pages")
def c23(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.mentions(F.col("html"), ["Ering", "LICENSE"]).alias("fetch"))


@query("c27_query_words", r"""
SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g')) AS words, regexp_matches(trim(regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g')), '(^|[^a-z0-9])the($|[^a-z0-9])') AS holds FROM benchmark""")
def c27(t: Tables) -> DataFrame:
    w = X.query_words(F.col("text"))
    return t.benchmark.select("item_id", w.alias("words"), X.holds(w, "the").alias("holds"))


@query("c28_template_fill", """
SELECT c_custkey, 'Hi ' || c_name || ', your ' || lower(c_mktsegment) || ' work' AS body FROM customer""")
def c28(t: Tables) -> DataFrame:
    body = X.fill("Hi  {first_name},  your {segment}   work ", {"first_name": X.first_name(F.concat("c_name", F.lit(" Smith"))), "segment": F.lower("c_mktsegment")})
    return t.customer.select("c_custkey", X.tidy(body).alias("body"))


@query("c29_xml_escape", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS sha FROM pages")
def c29(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(X.xml_escape(F.col("html")), 256).alias("sha"))


@query("c30_mask_email", f"""
WITH x AS (SELECT c_custkey, lower(trim({EMAIL_SQL})) AS e FROM customer)
SELECT c_custkey, '***@' || split_part(e, '@', 2) AS masked, substr(e, 1, 1) || '***@' || split_part(e, '@', 2) AS masked_keep FROM x WHERE strpos(e, '@') > 1 AND length(e) > strpos(e, '@')""")
def c30(t: Tables) -> DataFrame:
    e = X.normalize_email(F.col("raw"))
    return contacts(t).select("c_custkey", X.mask_email(e).alias("masked"), X.mask_email(e, 1).alias("masked_keep")).filter("masked is not null")


@query("c31_quote_clip", r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[{}]', '', 'g'), '\s+', ' ', 'g')) AS f FROM documents),
y AS (SELECT doc_id, f, substr(f, 1, 80) AS c, regexp_extract(substr(f, 1, 80), '^(.*) ', 1) AS w FROM x)
SELECT doc_id, CASE WHEN length(f) <= 80 THEN f WHEN w <> '' THEN w ELSE c END AS quote FROM y""")
def c31(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clip(F.col("text"), 80).alias("quote"))


@query("c32_milli_half_even", """
SELECT l_orderkey, l_linenumber, round_even((l_discount::DECIMAL(18,4) * l_tax::DECIMAL(18,4) * 1000)::DECIMAL(38,8), 0)::INTEGER AS milli FROM lineitem""")
def c32(t: Tables) -> DataFrame:
    x = F.col("l_discount").cast("decimal(18,4)") * F.col("l_tax").cast("decimal(18,4)")
    return t.lineitem.select("l_orderkey", "l_linenumber", V.milli(x).alias("milli"))


@query("c33_seeded_unit", """
SELECT user_id, (('0x' || substr(sha256('7:' || user_id || ':accept'), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE AS unit FROM (SELECT DISTINCT user_id FROM events)""")
def c33(t: Tables) -> DataFrame:
    return t.events.select("user_id").distinct().select("user_id", V.unit_interval(7, F.col("user_id"), "accept").alias("unit"))


@query("c34_printable", r"""
WITH x AS (SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', '?', 'g') AS c FROM documents)
SELECT doc_id, CASE WHEN length(c) > 60 THEN substr(c, 1, 59) || '…' ELSE c END AS shown FROM x""")
def c34(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.printable(F.col("text"), 60).alias("shown"))


CREDIT_SQL = "CASE o_orderkey % 5 WHEN 0 THEN '-1.5' WHEN 1 THEN '2.0005' WHEN 2 THEN '7' WHEN 3 THEN '0.1250' ELSE CAST(o_custkey AS VARCHAR) || '.25' END"


@query("c35_exact_credits", f"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 7000 WHEN 3 THEN 125 WHEN 4 THEN o_custkey * 1000 + 250 END AS milli_credits FROM orders""")
def c35(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", V.exact_credits(F.expr(CREDIT_SQL.replace("VARCHAR", "STRING"))).alias("milli_credits"))


@query("c36_provider_bill", """
SELECT o_orderpriority, (ceil(count(*) / 10.0) + count_if(o_orderstatus = 'F')) ::DECIMAL(18,3) + 0.500::DECIMAL(6,3) * count_if(o_orderstatus = 'P') AS bill0, 0 AS z FROM orders GROUP BY 1""".replace(" AS bill0, 0 AS z", "::DECIMAL(20,3) AS bill").replace("::DECIMAL(20,3) AS bill", " AS b").replace("SELECT o_orderpriority, (", "SELECT o_orderpriority, CAST((").replace(" AS b FROM", " AS DECIMAL(20,3)) AS bill FROM"))
def c36(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return per.select("o_orderpriority", V.provider_bill(F.col("n"), F.col("f"), F.col("p")).cast("decimal(20,3)").alias("bill"))


@query("c37_hits_billed", "SELECT event_type, count(DISTINCT user_id) FILTER (WHERE value > 100) AS billed FROM events GROUP BY 1")
def c37(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") > 100, F.col("user_id"))).alias("billed"))


@query("c38_status_map", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'verified' WHEN 'click' THEN 'accept_all' WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'invalid' END AS status FROM events""")
def c38(t: Tables) -> DataFrame:
    stated = F.expr("CASE event_type WHEN 'signup' THEN 'valid' WHEN 'click' THEN 'accept_all' WHEN 'view' THEN 'webmail' WHEN 'error' THEN 'invalid' ELSE 'new' END")
    return t.events.select("event_id", V.email_status(stated).alias("status"))


@query("c39_rung_confidence", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 0.9::DOUBLE WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.6 WHEN 'error' THEN 0.5 END AS confidence FROM events""")
def c39(t: Tables) -> DataFrame:
    rung = F.expr("CASE event_type WHEN 'signup' THEN 'id' WHEN 'click' THEN 'email' WHEN 'view' THEN 'name_domain' WHEN 'error' THEN 'name_org' END")
    return t.events.select("event_id", V.rung_confidence(rung).alias("confidence"))


@query("c40_retry_after", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (user_id + 1)::DOUBLE WHEN 1 THEN user_id + 0.5 END AS seconds FROM events""")
def c40(t: Tables) -> DataFrame:
    said = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(user_id + 1 AS STRING) WHEN 1 THEN CONCAT(CAST(user_id AS STRING), '.5') WHEN 2 THEN 'Wed, 21 Oct' ELSE '0' END")
    return t.events.select("event_id", V.retry_after(said).alias("seconds"))


@query("c41_still_employed", """
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'N') THEN true WHEN bool_and(l_returnflag = 'R') THEN false END AS is_current FROM lineitem GROUP BY 1""")
def c41(t: Tables) -> DataFrame:
    stated = F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False)
    jobs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(stated.alias("c"))).alias("j"))
    return jobs.select("l_orderkey", V.still_employed(F.transform("j", lambda x: x["c"])).alias("is_current"))


@query("b12_safe_cell", r"""
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '''=' || substr(text, 1, 20) WHEN item_id % 3 = 1 THEN '''+' || substr(text, 1, 5) ELSE substr(text, 1, 32767) END AS cell FROM benchmark""")
def b12(t: Tables) -> DataFrame:
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("=\u0007"), F.substring("text", 1, 20))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("+"), F.substring("text", 1, 5))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", X.safe_cell(raw).alias("cell"))


@query("d14_error_class", """
WITH s AS (SELECT event_id, ['people', 'email', 'crm'][user_id % 3 + 1] AS provider, [200, 401, 403, 404, 408, 429, 451, 500, 503][event_id % 9 + 1] AS status FROM events)
SELECT event_id, provider, status, CASE WHEN status < 400 THEN 'ok' WHEN provider = 'email' AND status = 403 THEN 'rate_limited' WHEN provider = 'email' AND status = 429 THEN 'quota'
 WHEN provider = 'email' AND status = 451 THEN 'compliance' WHEN status IN (401, 403) THEN 'unauthorized' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 OR status = 408 THEN 'transient' ELSE 'permanent' END AS class FROM s""")
def d14(t: Tables) -> DataFrame:
    provider = F.element_at(F.array(*map(F.lit, ("people", "email", "crm"))), (F.col("user_id") % 3 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 408, 429, 451, 500, 503))), (F.col("event_id") % 9 + 1).cast("int"))
    calls = t.events.select("event_id", provider.alias("provider"), status.alias("status"))
    return calls.withColumn("class", V.error_class(F.col("provider"), F.col("status")))


@query("d15_resolved_mode", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'live' WHEN s_nationkey % 3 = 0 THEN 'synthetic' WHEN s_suppkey % 2 = 1 THEN 'synthetic' WHEN s_acctbal < 0 THEN 'synthetic' ELSE 'live' END AS mode FROM supplier""")
def d15(t: Tables) -> DataFrame:
    one = F.when(F.col("s_suppkey") % 4 == 0, "live")
    overall = F.when(F.col("s_nationkey") % 3 == 0, "synthetic")
    return t.supplier.select("s_suppkey", V.resolved_mode(one, overall, F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") >= 0).alias("mode"))


@query("c42_redacted_rows", """SELECT c_custkey, '{"note":"' || CASE c_custkey % 4 WHEN 0 THEN 'key ***!' WHEN 1 THEN 'q=***&x' WHEN 2 THEN 'plain pin12' ELSE '*** ok' END || '","name":"' || c_name || '"}' AS line FROM customer""")
def c42(t: Tables) -> DataFrame:
    note = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'key s3cret/value!' WHEN 1 THEN 'q=s3cret%2Fvalue&x' WHEN 2 THEN 'plain pin12' ELSE 'pin1 ok' END")
    return t.customer.select("c_custkey", X.redact_row(F.struct(note.alias("note"), F.col("c_name").alias("name")), ["s3cret/value", "pin1"]).alias("line"))

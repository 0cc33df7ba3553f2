"""Queries over documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .. import scratch
from ..operators import binning, documents as D, stats
from ..operators.selection import group_quantiles, per_group
from ..functions.columns import ratio

#: A small lexicon of our own for the synthetic corpus: (word, category); a word may have several.
LEXICON = [
    ("WORTHLESS", "negative"), ("PATHETIC", "negative"), ("DISGUSTING", "negative"), ("LOSER", "negative"), ("NO", "negative"), ("PAS", "negative"),
    ("OF", "litigious"), ("DE", "litigious"), ("VON", "litigious"), ("BY", "litigious"),
    ("THAT", "uncertainty"), ("ONLY", "uncertainty"), ("QUE", "uncertainty"), ("ODER", "uncertainty"), ("NO", "uncertainty"),
    ("AND", "positive"), ("WITH", "positive"), ("ET", "positive"), ("UND", "positive"),
]
_VALUES = ", ".join(f"('{w}', '{c}')" for w, c in LEXICON)
_TOKENS = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '' and not regexp_full_match(x, '\p{{Nd}}+'))"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, category string")


def tokenise_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n_letters"))


TOKENISE = f"""with t as (select doc_id, {_TOKENS.format('text')} as t from documents)
select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::bigint as n_letters from t"""

_SHARES = f"""lex(word, category) as (values {_VALUES}),
docs as (select doc_id, {_TOKENS.format('text')} as t from documents where text is not null),
sized as (select doc_id, len(t) as n_tokens from docs where len(t) > 0),
hits as (select doc_id, category, count(*) as hits from (select doc_id, unnest(t) as w from docs) join lex on w = lower(word) group by all),
shares as (select s.doc_id, n_tokens, c.category, coalesce(hits, 0) as hits, coalesce(hits, 0) / n_tokens as share
  from sized s cross join (select distinct category from lex) c left join hits h on h.doc_id = s.doc_id and h.category = c.category)"""


def tone_ratios(spark, sf_dir):
    out = D.lexicon_shares(table(spark, sf_dir, "documents"), ["doc_id"], "text", lexicon(spark))
    return out.select("doc_id", "n_tokens", "category", "hits", F.round("share", 6).alias("share"))


TONE = f"with {_SHARES} select doc_id, n_tokens, category, hits, round(share, 6) as share from shares"


def tone_by_bin(spark, sf_dir):
    """The flagship: lexicon share of each document, its quintile, and the labelled outcome by quintile."""
    shares = D.lexicon_shares(table(spark, sf_dir, "documents"), ["doc_id"], "text", lexicon(spark)).where("category = 'litigious'").select("doc_id", "share")
    shares = scratch.write(shares)  # read for the edges, the bins and their medians
    binned = binning.qcut(shares, "share", 5, "bin").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    mid = group_quantiles(binned, ["bin"], "share", [0.5]).select("bin", F.round(F.col("q")[0], 6).alias("median_share"))
    out = binned.groupBy("bin").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    return per_group(out, mid, ["bin"], how="left")


TONE_BIN = f"""with {_SHARES}, s as (select doc_id, share from shares where category = 'litigious'),
e as (select distinct unnest(quantile_cont(share, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) as edge from s),
b as (select doc_id, share, greatest((select count(*) from e where edge < share) - 1, 0)::int as bin from s)
select bin, count(*) as n, count(quality) as n_labelled, round(avg(share), 6) as mean_share, round(quantile_cont(share, 0.5), 6) as median_share, round(avg(quality), 6) as mean_quality
from b left join labels using (doc_id) group by bin"""


def section_tone_concentration(spark, sf_dir):
    """Lexicon share of the opening paragraph against the whole text; paragraphs of at least ten tokens."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("full"), F.lit("opening")), F.array(F.col("text"), F.element_at(F.split("text", "\n"), 1)))).alias("section", "body"))
    s = D.lexicon_shares(parts, ["doc_id", "section"], "body", lexicon(spark)).where("section = 'full' or n_tokens >= 10").where("category = 'positive'")
    wide = s.groupBy("doc_id").pivot("section", ["full", "opening"]).agg(F.first("share"))
    return wide.select("doc_id", F.round("full", 6).alias("full_share"), F.round("opening", 6).alias("opening_share"), F.round(ratio(F.col("opening"), F.col("full")), 6).alias("concentration"))


SECTION_TONE = f"""with lex(word, category) as (values {_VALUES}),
parts as (select doc_id, 'full' as section, {_TOKENS.format('text')} as t from documents where text is not null
  union all select doc_id, 'opening', {_TOKENS.format("string_split(text, chr(10))[1]")} from documents where text is not null),
kept as (select * from parts where len(t) > 0 and (section = 'full' or len(t) >= 10)),
hits as (select doc_id, section, count(*) as hits from (select doc_id, section, unnest(t) as w from kept) join lex on w = lower(word) where category = 'positive' group by all),
s as (select k.doc_id, k.section, coalesce(hits, 0) / len(t) as share from kept k left join hits h on h.doc_id = k.doc_id and h.section = k.section),
w as (select doc_id, max(share) filter (where section = 'full') as f, max(share) filter (where section = 'opening') as o from s group by doc_id)
select doc_id, round(f, 6) as full_share, round(o, 6) as opening_share, round(case when f > 0 then o / f end, 6) as concentration from w"""


def fog_index(spark, sf_dir):
    return D.fog(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("fog", F.round("fog", 4))


_SYL = "greatest(1, len(regexp_extract_all({0}, '[aeiouy]+')) - case when {0} like '%e' and len(regexp_extract_all({0}, '[aeiouy]+')) > 1 then 1 else 0 end)"
_STEM = "(case when x like '%ing' then left(x, greatest(length(x) - 3, 0)) when x like '%ed' or x like '%es' or x like '%ly' then left(x, greatest(length(x) - 2, 0)) else x end)"
FOG = f"""with t as (select doc_id, {_TOKENS.format('text')} as t, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}]'))) as sentences from documents),
n as (select doc_id, len(t) as words, sentences, len(list_filter(t, lambda x: {_SYL.format('x')} >= 3 and {_SYL.format(_STEM)} >= 3)) as complex from t)
select doc_id, words, sentences, complex, round(case when words > 0 and sentences > 0 then 0.4 * (words / sentences + 100 * complex / words) end, 4) as fog from n"""


def _tfidf_sql(docs: str) -> str:
    return f"""base as (select doc_id, list_filter({_TOKENS.format('text')}, lambda x: length(x) >= 2) as t from {docs}),
grams as (select doc_id, unnest(list_concat(t, list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2]))) as term from base where len(t) > 0),
tf as (select doc_id, term, count(*) as tf from grams group by all),
vocab as (select term, sum(tf) as al, count(*) as df from tf group by term having count(*) >= 2 order by al desc, term limit 5000),
idf as (select term, ln((1 + (select count(*) from {docs})) / (1 + df)) + 1 as idf from vocab),
raw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join idf using (term)),
unit as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from raw)"""


def tfidf_top_terms(spark, sf_dir):
    w = D.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text")
    return w.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("w"), 5).alias("weight")).orderBy(F.desc("weight"), "term").limit(25)


TFIDF = f"with {_tfidf_sql('documents')} select term, count(*) as df, round(sum(w), 5) as weight from unit group by term order by weight desc, term limit 25"


#: Frequent words of the synthetic corpus.
STOP = ["the", "and", "of", "to", "is", "la", "de", "que", "die", "und", "el", "on"]


def tfidf_stop_terms(spark, sf_dir):
    """Top terms without stop words, which go before pairs of words are made."""
    w = D.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text", STOP)
    return w.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("w"), 5).alias("weight")).orderBy(F.desc("weight"), "term").limit(25)


TFIDF_STOP = TFIDF.replace("length(x) >= 2", f"length(x) >= 2 and x not in ({', '.join(repr(w) for w in STOP)})")


def expanding_uniqueness(spark, sf_dir):
    out = D.expanding_uniqueness(table(spark, sf_dir, "documents"), "doc_id", "text", "source", ["doc_id"])
    return out.select("doc_id", "prior", F.round("uniqueness", 6).alias("uniqueness"))


UNIQUENESS = f"""with live as (select * from documents where len({_TOKENS.format('text')}) > 0), {_tfidf_sql('live')},
dots as (select doc_id, sum(w * s) as dot, sum(w * w) as sq from (
  select u.doc_id, w, coalesce(sum(w) over (partition by source, term order by u.doc_id rows between unbounded preceding and 1 preceding), 0) as s from unit u join live d on d.doc_id = u.doc_id) group by doc_id),
run as (select l.doc_id, coalesce(dot, 0) as dot, coalesce(sq, 0) as sq, count(*) over w as prior, sum(2 * coalesce(dot, 0) + coalesce(sq, 0)) over w as len
  from live l left join dots d on d.doc_id = l.doc_id window w as (partition by source order by l.doc_id rows between unbounded preceding and 1 preceding))
select doc_id, prior, round(case when prior >= 5 and sq > 0 and len > 0 then 1 - dot / sqrt(len) end, 6) as uniqueness from run"""


def html_to_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return t.select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


HTML = r"""with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') as text from pages)
select page_id, length(text) as n_chars, sha256(text) as text_sha256 from t"""


def html_exact(spark, sf_dir):
    """Pages made of documents with scripts, styles and character references, read by the parser."""
    body = F.coalesce("text", F.lit(""))
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;")):
        body = F.replace(body, F.lit(sign), F.lit(reference))
    html = F.concat(F.lit("<html><head><meta charset='utf-8'><link rel='x'><style>p > a { color: red }</style></head><body><p class='a>b'>"), body, F.lit("</p><script>if (a < b) { x('<p>no</p>'); }</script></body></html>"))
    t = table(spark, sf_dir, "documents").select("doc_id", T.exact_text(html).alias("text"))
    return t.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


# the text that went in, with blanks and blank lines collapsed
HTML_EXACT = r"""with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents)
select doc_id, length(text) as n_chars, sha256(text) as text_sha256 from t"""


def risk_tone(spark, sf_dir):
    """Lexicon share of a filing's risk section against the whole filing; sections of at least 100 tokens."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    page = lambda heading, body: [F.lit(f"\nTable of Contents\n{heading}\n"), body]
    filing = F.concat(*page("PROSPECTUS SUMMARY", F.lit("With us.")), *page("RISK FACTORS", F.col("text")), *[x for h in ("USE OF PROCEEDS", "DIVIDEND POLICY", "LEGAL MATTERS") for x in page(h, F.lit("And none."))])
    filings = docs.select("doc_id", filing.alias("body"))
    risk = D.sections(filings, ["doc_id"], "body").where("section = 'risk_factors'").select("doc_id", F.lit("rf").alias("section"), "body")
    s = D.lexicon_shares(filings.select("doc_id", F.lit("full").alias("section"), "body").union(risk), ["doc_id", "section"], "body", lexicon(spark)).where("section = 'full' or n_tokens >= 100").where("category = 'positive'")
    wide = s.groupBy("doc_id").pivot("section", ["full", "rf"]).agg(F.first("share"))
    return wide.select("doc_id", F.round("full", 6).alias("share"), F.round("rf", 6).alias("rf_share"), F.round(ratio(F.col("rf"), F.col("full")), 6).alias("concentration"))


RISK_TONE = SECTION_TONE.replace(
    _TOKENS.format("text"), _TOKENS.format("filing")
).replace(_TOKENS.format("string_split(text, chr(10))[1]"), _TOKENS.format("risk")).replace("from documents where text is not null", "from filings").replace("'opening'", "'rf'").replace("len(t) >= 10)", "len(t) >= 100)")
RISK_TONE = RISK_TONE.replace("parts as (", """filings as (select doc_id, 'Table of Contents PROSPECTUS SUMMARY With us. Table of Contents RISK FACTORS ' || text || ' Table of Contents USE OF PROCEEDS And none. Table of Contents DIVIDEND POLICY And none. Table of Contents LEGAL MATTERS And none.' as filing,
  case when length(text) + 31 >= 500 then 'RISK FACTORS ' || text || ' Table of Contents' end as risk from documents where text is not null),
parts as (""", 1).replace("as full_share, round(o, 6) as opening_share", "as share, round(o, 6) as rf_share")


def page_sections(spark, sf_dir):
    """Documents bound to filings with page breaks and headings, then split again."""
    docs = table(spark, sf_dir, "documents")
    filing = F.concat(*[x for h in ("PROSPECTUS SUMMARY", "RISK FACTORS", "USE OF PROCEEDS", "DIVIDEND POLICY", "LEGAL MATTERS") for x in (F.lit(f"\nTable of Contents\n{h}\n"), F.col("text"))])
    out = D.sections(docs.select("doc_id", filing.alias("filing")), ["doc_id"], "filing")
    return out.select("doc_id", "section", F.char_length("body").cast("long").alias("n_chars"))


SECTIONS = r"""with h(section, head, at_end) as (values ('prospectus_summary', 'PROSPECTUS SUMMARY', false), ('risk_factors', 'RISK FACTORS', false), ('use_of_proceeds', 'USE OF PROCEEDS', false), ('dividend_policy', 'DIVIDEND POLICY', false),
  ('legal_matters', 'LEGAL MATTERS', true)),
b as (select doc_id, section, case when at_end then regexp_replace(head || chr(10) || text, '\s+$', '') else head || chr(10) || text || chr(10) || 'Table of Contents' end as body from documents, h where text is not null)
select doc_id, section, length(body) as n_chars from b where length(body) >= 500"""


def share_count_extract(spark, sf_dir):
    """Share counts of documents into whose text a banner is set after the first line; the count depends on the text."""
    docs = table(spark, sf_dir, "documents")
    cut = F.locate("\n", F.col("text"))
    banner = F.concat(F.lit(" PRELIMINARY PROSPECTUS "), F.format_number(F.char_length("text") * 7919 + 100_000, 0), F.lit(" Shares Common Stock "))
    page = F.when(cut > 0, F.concat(F.substring("text", F.lit(1), cut), banner, F.substring(F.col("text"), cut + 1, F.char_length("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", T.filed_shares(page).alias("shares"))


# found by a search of the same pages
SHARES = r"""with p as (select doc_id, case when instr(text, chr(10)) > 0 then left(text, instr(text, chr(10))) || ' PRELIMINARY PROSPECTUS ' || format('{:,}', length(text) * 7919 + 100000) || ' Shares Common Stock ' || substr(text, instr(text, chr(10)) + 1) else coalesce(text, '') end as page from documents),
c as (select doc_id, regexp_extract(left(regexp_replace(left(page, 60000), '\s+', ' ', 'g'), 8000), '(?is)(?:prospectus|subject\s+to\s+completion).{0,180}?\b(\d[\d,]{5,})\s+(?:shares|american\s+depositary\s+shares|adss|units)\b', 1) as n from p)
select doc_id, nullif(replace(n, ',', ''), '')::double as shares from c"""


def normalise_names(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(" & Co. LLC (ABC)")).alias("name"))
    names = names.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("J.P. "), F.col("c_name"), F.lit(" Securities Holdings, Inc.")).alias("name")))
    return names.select("key", "name", T.company_key(F.col("name")).alias("company"))


NAMES = rf"""with n as (select s_suppkey as key, s_name || ' & Co. LLC (ABC)' as name from supplier union all select c_custkey, 'J.P. ' || c_name || ' Securities Holdings, Inc.' from customer)
select key, name, trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(name), '\([^)]*\)', ' ', 'g'), '&', ' and '), '\b({T.LEGAL_FORMS})\b\.?', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) as company from n"""


def _place(page: str, term: str) -> str:
    """Where a term stands first between other signs than letters and digits, from 1; 0 if nowhere."""
    return f"length(regexp_extract(' ' || {page} || ' ', '(?s)^(.*?[^0-9A-Za-z]){term}[^0-9A-Za-z]', 1))"


def _without(page: str, place: str, size: int) -> str:
    """The page with a term's characters taken."""
    return f"case when {place} > 0 then left({page}, {place} - 1) || repeat('#', {size}) || substr({page}, {place} + {size}) else {page} end"


_TERMS = D.search_terms({"the and attion": "Attion Partners", "disgusting pathetic": "Pathetic Brothers", "the": "The House"}, {"that and": "That and Sons", "loser": "Loser"}, {"loser"})


def spot_entities(spark, sf_dir):
    return D.spot_entities(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS).select("doc_id", F.array_join("names", "; ").alias("names"), F.size("names").alias("n"))


# a term's first place, the longest first, each on the page without the characters of the longer ones
ENTITIES = rf"""with c as (select doc_id, left(regexp_replace(left(coalesce(text, ''), 60000), '\s+', ' ', 'g'), 20000) as page from documents),
p0 as (select doc_id, regexp_replace(regexp_replace(replace(lower(page), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g') as page from c),
p1 as (select *, {_place('page', 'disgusting pathetic')} as a from p0), p2 as (select *, {_without('page', 'a', 19)} as page1 from p1),
p3 as (select *, {_place('page1', 'the and attion')} as b from p2), p4 as (select *, {_without('page1', 'b', 14)} as page2 from p3),
p5 as (select *, {_place('page2', 'that and')} as c from p4), p6 as (select *, {_without('page2', 'c', 8)} as page3 from p5),
p7 as (select *, {_place('page3', 'the')} as d from p6),
n as (select doc_id, unnest([struct_pack(p := a, n := 'Pathetic Brothers'), struct_pack(p := b, n := 'Attion Partners'), struct_pack(p := c, n := 'That and Sons'), struct_pack(p := d, n := 'The House')]) as x from p7)
select doc_id, coalesce(string_agg(x.n, '; ' order by x.p) filter (where x.p > 0), '') as names, (count(*) filter (where x.p > 0))::int as n from n group by doc_id"""

_COUNSEL = "Copies to: Disgusting Pathetic of The and Attion, counsel. "


def spot_underwriters(spark, sf_dir):
    """Entities on pages that begin with a list of counsel, without the issuer's own names."""
    docs = table(spark, sf_dir, "documents")
    page = F.concat(F.lit(_COUNSEL + "Approximate date of commencement of sale: soon. "), F.coalesce("text", F.lit("")))
    issuer = F.when(F.col("doc_id") % 2 == 0, "Attion Partners, Inc.").when(F.col("doc_id") % 3 == 0, "That and Sons & Co. (Holding)")
    return D.spot_entities(docs.select("doc_id", page.alias("page"), issuer.alias("issuer")), "doc_id", "page", _TERMS, "issuer").select("doc_id", F.array_join("names", "; ").alias("names"))


UNDERWRITERS = ENTITIES.replace("left(regexp_replace(left(coalesce(text, ''), 60000), '\\s+', ' ', 'g'), 20000)", f"""' ' || substr(left(regexp_replace(left('{_COUNSEL}Approximate date of commencement of sale: soon. ' || coalesce(text, ''), 60000), '\\s+', ' ', 'g'), 20000), {len(_COUNSEL) + 1})""")
UNDERWRITERS = UNDERWRITERS.replace("filter (where x.p > 0), '') as names, (count(*) filter (where x.p > 0))::int as n from", "filter (where x.p > 0 and not (doc_id % 2 = 0 and x.n = 'Attion Partners') and not (doc_id % 2 <> 0 and doc_id % 3 = 0 and x.n = 'That and Sons')), '') as names from")

QUERIES = {
    "tone_by_bin": (tone_by_bin, TONE_BIN), "tokenise_stats": (tokenise_stats, TOKENISE), "tone_ratios": (tone_ratios, TONE), "section_tone_concentration": (section_tone_concentration, SECTION_TONE),
    "fog_index": (fog_index, FOG), "tfidf_top_terms": (tfidf_top_terms, TFIDF), "tfidf_stop_terms": (tfidf_stop_terms, TFIDF_STOP), "expanding_uniqueness": (expanding_uniqueness, UNIQUENESS), "html_to_text": (html_to_text, HTML), "html_exact": (html_exact, HTML_EXACT), "risk_tone": (risk_tone, RISK_TONE),
    "page_sections": (page_sections, SECTIONS), "share_count_extract": (share_count_extract, SHARES), "normalise_names": (normalise_names, NAMES), "spot_entities": (spot_entities, ENTITIES), "spot_underwriters": (spot_underwriters, UNDERWRITERS),
}

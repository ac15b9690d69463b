"""Numbers, answers, spans, digests, step functions on orders, pages and documents."""
from pyspark.sql import functions as F

from evalspark.bindings.base import RESPONSES, TRAJ, query, responses, shown, spread, sql_canon, sql_digits, sql_norm, sql_strip, sql_text, table, trajectories
from evalspark.functions import answers, digests, numbers as N, spans, steps as S, text as X
from evalspark.plans import scoring

G = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
L = r"[-+]?\d[\d,]*(?:\.\d+)?"


@query("f01_digit_mapping", f"WITH {RESPONSES} SELECT problem_id, language, {sql_digits('generated_response')} AS mapped FROM responses WHERE generated_response IS NOT NULL")
def f01(spark, d):
    return responses(spark, d).where("generated_response IS NOT NULL").select("problem_id", "language", N.ascii_digits(F.col("generated_response")).alias("mapped"))


# Number texts with every kind of decoration, from order totals.
RAW = f"""{RESPONSES}, raws AS (SELECT problem_id, language, CASE problem_id % 8 WHEN 0 THEN ' $' || grouped || '.50 ' WHEN 1 THEN replace(eastern, '', '') || '٫٥'
  WHEN 2 THEN txt || '0' WHEN 3 THEN '-' || grouped WHEN 4 THEN 'n/a' WHEN 5 THEN '00' || grouped || '.00' WHEN 6 THEN txt || '%' ELSE '+' || txt END AS raw FROM responses)"""


def raws(spark, d):
    p = F.col("problem_id") % 8
    raw = F.when(p == 0, F.concat(F.lit(" $"), "grouped", F.lit(".50 "))).when(p == 1, F.concat("eastern", F.lit("٫٥"))) \
        .when(p == 2, F.concat("txt", F.lit("0"))).when(p == 3, F.concat(F.lit("-"), "grouped")).when(p == 4, F.lit("n/a")) \
        .when(p == 5, F.concat(F.lit("00"), "grouped", F.lit(".00"))).when(p == 6, F.concat("txt", F.lit("%"))).otherwise(F.concat(F.lit("+"), "txt"))
    return responses(spark, d).select("problem_id", "language", raw.alias("raw"))


@query("f02_normalize_decimal", f"WITH {RAW} SELECT problem_id, language, raw, {sql_norm('raw')} AS plain, {sql_norm('raw', True)} AS without_percent FROM raws")
def f02(spark, d):
    return raws(spark, d).withColumn("plain", N.normalize_decimal(F.col("raw"))).withColumn("without_percent", N.normalize_decimal(F.col("raw"), True))


@query("f03_normalize_float", f"""WITH {RAW}, a AS (SELECT *, translate({sql_strip(sql_digits('raw'))}, '٫,٬$ ', '.') AS t, translate({sql_strip('raw')}, ',', '') AS u FROM raws)
SELECT problem_id, language, CASE WHEN try_cast(t AS DOUBLE) = floor(try_cast(t AS DOUBLE)) THEN CAST(try_cast(t AS DOUBLE) AS BIGINT)::VARCHAR ELSE t END AS integral,
 CASE WHEN regexp_matches(u, '^[-+]?(?:\\d+\\.?\\d*|\\.\\d+)$') THEN {sql_canon('u')} ELSE u END AS float_text FROM a""")
def f03(spark, d):
    return raws(spark, d).select("problem_id", "language", N.normalize_integral(F.col("raw")).alias("integral"), N.normalize_float_text(F.col("raw")).alias("float_text"))


@query("f04_normalize_currency", f"""WITH {RAW}, a AS (SELECT *, {sql_strip("translate(" + sql_strip('raw') + ", ',$€£%', '')")} AS t,
  regexp_extract_all(string_split(translate('total 12 #### ' || raw, ',$£€', ''), '####')[-1], '-?\\d+(?:\\.\\d+)?')[-1] AS m FROM raws)
SELECT problem_id, language, CASE WHEN regexp_matches(t, '^[-+]?(?:\\d+\\.?\\d*|\\.\\d+)$') THEN {sql_canon('t')} END AS currency,
 CASE WHEN m IS NOT NULL THEN {sql_canon('m')} END AS marked FROM a""")
def f04(spark, d):
    return raws(spark, d).select("problem_id", "language", N.normalize_currency(F.col("raw")).alias("currency"),
                                 N.marked_answer(F.concat(F.lit("total 12 #### "), "raw")).alias("marked"))


@query("f05_numeric_equal", f"""WITH {RAW}, a AS (SELECT r.problem_id, r.language, r.raw, p.gold_answer FROM raws r JOIN responses p USING (problem_id, language)),
 b AS (SELECT *, {sql_norm('raw')} AS pn, {sql_norm('gold_answer')} AS gn, {sql_strip('raw')} AS ps, {sql_strip('gold_answer')} AS gs,
  {sql_strip("translate(raw, ',$€£%', '')")} AS pc, {sql_strip("translate(gold_answer, ',$€£%', '')")} AS gc FROM a)
SELECT problem_id, language, coalesce(pn = gn, false) AS decimal_text,
 regexp_matches(ps, '^[-+]?(?:\\d+\\.?\\d*|\\.\\d+)$') AND coalesce(try_cast(ps AS DECIMAL(38,10)) = try_cast(gs AS DECIMAL(38,10)), false) AS decimal_strict,
 CASE WHEN regexp_matches(ps, '^[-+]?(?:\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(ps AS DOUBLE) = try_cast(gs AS DOUBLE) ELSE ps = gs END AS float_text,
 coalesce(try_cast(pc AS DECIMAL(38,10)) = try_cast(gc AS DECIMAL(38,10)), false) AS currency FROM b""")
def f05(spark, d):
    gold = responses(spark, d).select("problem_id", "language", "gold_answer")
    joined = raws(spark, d).join(gold, ["problem_id", "language"])
    return joined.select("problem_id", "language", *[N.numeric_equal(F.col("raw"), F.col("gold_answer"), m).alias(m)
                                                     for m in ("decimal_text", "decimal_strict", "float_text", "currency")])


EXA = rf"""{RESPONSES}, ta AS (SELECT *, {sql_text("coalesce(generated_response, '')")} AS t FROM responses),
 tb AS (SELECT *, list_transform(regexp_extract_all(t, '(?i)(?:FINAL\s+ANSWER|الإجابة\s+النهائية)\s*:\s*({G})', 1), lambda x: x) AS vals,
  regexp_extract_all(t, '(?i)(FINAL\s+ANSWER|الإجابة\s+النهائية)\s*:\s*{G}', 1)[1] AS kind,
  regexp_extract_all(t, '\\boxed\s*\{{\s*({G})\s*\}}', 1)[-1] AS boxed, regexp_extract_all(t, '({G})', 1)[-1] AS num FROM ta),
 tc AS (SELECT problem_id, language, model, gold_answer, finish_reason, status, boxed, num, kind, (SELECT list(v ORDER BY i) FROM
   (SELECT i, {sql_norm('vals[i]')} AS v FROM generate_series(1, len(vals)) g(i))) AS ex FROM tb),
 td AS (SELECT *, CASE WHEN ex IS NOT NULL THEN ex[1] WHEN boxed IS NOT NULL THEN {sql_norm('boxed')} WHEN num IS NOT NULL THEN {sql_norm('num')} END AS answer,
  CASE WHEN ex IS NOT NULL THEN CASE WHEN regexp_matches(kind, '(?i)^final') THEN 'english_final_marker' ELSE 'arabic_final_marker' END
   WHEN boxed IS NOT NULL THEN 'boxed' WHEN num IS NOT NULL THEN 'last_number_fallback' ELSE 'no_number' END AS method,
  CASE WHEN ex IS NOT NULL THEN (len(list_distinct(ex)) > 1)::INT ELSE 1 END AS needs_review,
  CASE WHEN ex IS NOT NULL THEN CASE WHEN len(list_distinct(ex)) > 1 THEN 'conflicting_explicit_final_answers' ELSE '' END
   WHEN boxed IS NOT NULL THEN 'no_requested_final_marker' WHEN num IS NOT NULL THEN 'fallback_extraction' ELSE 'no_numeric_answer' END AS reason,
  CASE WHEN ex IS NOT NULL THEN array_to_string(ex, '|') WHEN boxed IS NOT NULL THEN {sql_norm('boxed')} ELSE '' END AS all_answers FROM tc)"""


@query("f06_extract_first_marker", f"WITH {EXA} SELECT problem_id, language, answer, method, needs_review, reason, all_answers FROM td")
def f06(spark, d):
    return answers.extract_first_marker(responses(spark, d), "generated_response", "x").select("problem_id", "language", "x.*")


@query("f07_extract_last_marker", rf"""WITH {RESPONSES}, t AS (SELECT *, {sql_text("coalesce(generated_response, '')")} AS t FROM responses),
 u AS (SELECT *, regexp_extract_all(t, '(?i)FINAL\s+ANSWER\s*:\s*({L})', 1)[-1] AS e, regexp_extract_all(t, 'الإجابة\s+النهائية\s*:\s*({L})', 1)[-1] AS a,
  regexp_extract_all(t, '\\boxed\s*\{{\s*({L})\s*\}}', 1)[-1] AS b, regexp_extract_all(t, '({L})', 1)[-1] AS n FROM t)
SELECT problem_id, language, CASE WHEN coalesce(e, a, b, n) IS NOT NULL THEN {sql_norm('coalesce(e, a, b, n)')} END AS answer,
 CASE WHEN e IS NOT NULL THEN 'english_final_marker' WHEN a IS NOT NULL THEN 'arabic_final_marker' WHEN b IS NOT NULL THEN 'boxed' WHEN n IS NOT NULL THEN 'last_number_fallback' ELSE 'no_number' END AS method FROM u""")
def f07(spark, d):
    return answers.extract_last_marker(responses(spark, d), "generated_response", "x").select("problem_id", "language", "x.*")


def _located(k: int, label: str, pattern: str) -> str:
    """Matches of one phrase family with their position, rebuilt from the pieces between matches."""
    return rf"""SELECT problem_id, language, {k} AS k, '{label}' AS label, regexp_extract_all(t, '{pattern}', 1)[i] AS v,
 (SELECT coalesce(sum(len(p)), 0) FROM (SELECT unnest(regexp_split_to_array(t, '{pattern}')[1:i]) AS p))
 + (SELECT coalesce(sum(len(p)), 0) FROM (SELECT unnest(regexp_extract_all(t, '{pattern}', 0)[1:i-1]) AS p)) AS pos
 FROM ta, generate_series(1, 40) g(i) WHERE i <= len(regexp_extract_all(t, '{pattern}', 0))"""


REPARSED = rf"""{RESPONSES}, ta AS (SELECT *, {sql_text("coalesce(generated_response, '')")} AS t FROM responses),
 loc0 AS ({" UNION ALL ".join(_located(k, label, p.replace("(?iu)", "(?i)")) for k, (label, p) in enumerate(answers.REPARSE_PATTERNS))}),
 loc1 AS (SELECT *, {sql_norm('v', True)} AS value FROM loc0),
 loc2 AS (SELECT problem_id, language, pos, value, arg_min(label, k) AS label, min(k) AS k FROM loc1 GROUP BY ALL),
 loc3 AS (SELECT problem_id, language, list(value ORDER BY pos, k) AS vs, list(label ORDER BY pos, k) AS ls FROM loc2 GROUP BY ALL),
 rep0 AS (SELECT r.*, vs, ls, regexp_extract_all(t, '({G})', 1)[-1] AS num FROM ta r LEFT JOIN loc3 USING (problem_id, language)),
 rep AS (SELECT problem_id, language, gold_answer, CASE WHEN vs IS NOT NULL THEN vs[1] WHEN num IS NOT NULL THEN {sql_norm('num', True)} END AS answer,
  CASE WHEN vs IS NOT NULL THEN ls[1] WHEN num IS NOT NULL THEN 'last_number_fallback' ELSE 'no_number' END AS method,
  CASE WHEN vs IS NOT NULL THEN (len(list_distinct(vs)) > 1)::INT ELSE 1 END AS needs_review,
  CASE WHEN vs IS NOT NULL THEN CASE WHEN len(list_distinct(vs)) > 1 THEN 'conflicting_explicit_answers' ELSE '' END WHEN num IS NOT NULL THEN 'fallback_extraction' ELSE 'no_numeric_answer' END AS reason,
  coalesce(array_to_string(vs, '|'), '') AS all_answers FROM rep0)"""


@query("f08_extract_reparsed", f"WITH {REPARSED} SELECT problem_id, language, answer, method, needs_review, reason, all_answers FROM rep")
def f08(spark, d):
    return answers.extract_reparsed(responses(spark, d), "generated_response", "x").select("problem_id", "language", "x.*")


@query("f09_extract_labelled", rf"""WITH {RESPONSES}, t AS (SELECT *, {sql_text("coalesce(generated_response, '')")} AS t FROM responses),
 u AS (SELECT *, regexp_extract_all(t, '(?i)FINAL ANSWER\s*:\s*\$?\s*(-?\d[\d,]*(?:\.\d+)?)', 1)[-1] AS e, regexp_extract_all(t, '(-?\d[\d,]*(?:\.\d+)?)', 1)[-1] AS n,
  regexp_extract_all(t, '(?i)FINAL\s*ANSWER\s*:\s*([-+]?(?:\d[\d,]*\.?\d*|\.\d+))', 1)[-1] AS e2, regexp_extract_all(t, '([-+]?(?:\d[\d,]*\.?\d*|\.\d+))', 1)[-1] AS n2 FROM t)
SELECT problem_id, language, CASE WHEN coalesce(e, n) IS NOT NULL THEN {sql_canon("replace(coalesce(e, n), ',', '')")} END AS labelled,
 CASE WHEN e IS NOT NULL THEN 'explicit_final' WHEN n IS NOT NULL THEN 'last_number' ELSE 'none' END AS labelled_method, replace(coalesce(e2, n2), ',', '') AS dotted FROM u""")
def f09(spark, d):
    out = answers.extract_dotted(answers.extract_labelled(responses(spark, d), "generated_response", "x"), "generated_response", "y")
    return out.select("problem_id", "language", F.col("x.answer").alias("labelled"), F.col("x.method").alias("labelled_method"), F.col("y.answer").alias("dotted"))


@query("f10_truncation_flag", f"""WITH {RESPONSES} SELECT problem_id, language, CASE WHEN finish_reason = 'length' THEN 1 ELSE 0 END AS needs_review,
 CASE WHEN finish_reason = 'length' THEN CASE WHEN status = 'error' THEN 'error|generation_truncated' ELSE 'generation_truncated' END
  ELSE CASE WHEN status = 'error' THEN 'error' ELSE '' END END AS reason FROM responses""")
def f10(spark, d):
    reason = F.when(F.col("status") == "error", "error").otherwise("")
    review, why = answers.flag_truncated(F.lit(0), reason, F.col("finish_reason"))
    return responses(spark, d).select("problem_id", "language", review.alias("needs_review"), why.alias("reason"))


@query("c12_score_responses", f"""WITH {EXA}, te AS (SELECT *, {sql_norm('gold_answer')} AS gn FROM td)
SELECT problem_id, language, model, answer AS extracted_answer, method AS extraction_method, CASE WHEN finish_reason = 'length' THEN 1 ELSE needs_review END AS needs_manual_review,
 CASE WHEN finish_reason = 'length' THEN CASE WHEN reason = '' THEN '' ELSE reason || '|' END || 'generation_truncated' ELSE reason END AS review_reason,
 coalesce((answer = gn)::INT, 0) AS is_correct FROM te""")
def c12(spark, d):
    return scoring.score_responses(responses(spark, d)).select("problem_id", "language", "model", "extracted_answer", "extraction_method",
                                                               "needs_manual_review", "review_reason", "is_correct")


@query("c13_reparse", f"""WITH {REPARSED}, o AS (SELECT *, (problem_id % 2)::INT AS old_is_correct, {sql_norm('gold_answer')} AS gn FROM rep)
SELECT problem_id, language, old_is_correct, answer AS extracted_answer, coalesce((answer = gn)::INT, 0) AS is_correct,
 (old_is_correct <> coalesce((answer = gn)::INT, 0))::INT AS score_changed FROM o""")
def c13(spark, d):
    old = responses(spark, d).withColumn("is_correct", (F.col("problem_id") % 2).cast("int")).withColumn("extracted_answer", F.lit("0"))
    return scoring.reparse(old, "generated_response", "gold_answer").select("problem_id", "language", "old_is_correct", "extracted_answer", "is_correct", "score_changed")


@query("a25_scoring_changes", f"""WITH {EXA} SELECT problem_id, language, CASE WHEN problem_id % 3 > 0 THEN (problem_id % 3 - 1)::INT END AS old_correct, coalesce((answer = {sql_norm('gold_answer')})::INT, 0) AS is_correct
 FROM td WHERE coalesce(CASE WHEN problem_id % 3 > 0 THEN problem_id % 3 - 1 END, 0) <> coalesce((answer = {sql_norm('gold_answer')})::INT, 0)""")
def a25(spark, d):
    from evalspark.operators.pairs import scoring_changes
    scored = scoring.score_responses(responses(spark, d)).withColumn("old_correct", F.when(F.col("problem_id") % 3 > 0, (F.col("problem_id") % 3 - 1).cast("int")))
    return scoring_changes(scored, "old_correct", "is_correct").select("problem_id", "language", "old_correct", "is_correct")


@query("f11_number_multiset", rf"""WITH a AS (SELECT page_id, {sql_digits('html')} AS t, {sql_digits("html || CASE WHEN page_id % 3 = 0 THEN ' 7' ELSE '' END")} AS u FROM pages),
 b AS (SELECT page_id, list_transform(regexp_extract_all(translate(t, '٬٫', ',.'), '({L})', 1), lambda x: translate(x, ',', '')) AS x, list_transform(regexp_extract_all(translate(u, '٬٫', ',.'), '({L})', 1), lambda x: translate(x, ',', '')) AS y FROM a)
SELECT page_id, len(x) AS n_numbers, list_sort(list_transform(x, lambda v: CAST(v AS DECIMAL(38,6)))) = list_sort(list_transform(y, lambda v: CAST(v AS DECIMAL(38,6)))) AS same FROM b""")
def f11(spark, d):
    pages = table(spark, d, "pages", ["page_id", "html"])
    other = F.concat("html", F.when(F.col("page_id") % 3 == 0, " 7").otherwise(""))
    return pages.select("page_id", F.size(N.numbers_in(F.col("html"))).cast("bigint").alias("n_numbers"), N.same_numbers(F.col("html"), other).alias("same"))


@query("f12_number_sequence", r"""SELECT page_id, array_to_string(regexp_extract_all(html, '\d+(?:\.\d+)?'), ' ') AS numbers,
 regexp_extract_all(html, '\d+(?:\.\d+)?') = regexp_extract_all(CASE WHEN page_id % 4 = 0 THEN replace(html, '1', '2') ELSE html END, '\d+(?:\.\d+)?') AS same FROM pages""")
def f12(spark, d):
    other = F.when(F.col("page_id") % 4 == 0, F.replace(F.col("html"), F.lit("1"), F.lit("2"))).otherwise(F.col("html"))
    return table(spark, d, "pages", ["page_id", "html"]).select("page_id", F.array_join(N.number_sequence(F.col("html")), " ").alias("numbers"),
                                                                N.same_number_sequence(F.col("html"), other).alias("same"))


# Texts with protected spans: page text around formulas made of ids.
PROT = r"(?s)(\$\$.*?\$\$|\$(?:\\.|[^$])*\$|\\\[.*?\\\]|\[\*\s*\{.*?\}\s*\])"
SPANNED = r"""spanned AS (SELECT doc_id, 'Step ' || text || ' costs $x_' || doc_id || '\$^2$ and \[y=' || (doc_id % 7) || '\] then $$z' || chr(10) || '$$ [* { id: "5" }] end' AS src FROM documents)"""
# Placeholder pieces are joined again in order, which needs matching pieces and fills only.
TEMPLATE = "(SELECT string_agg(coalesce(p[i], '') || CASE WHEN i <= len(f) THEN f[i] ELSE '' END, '' ORDER BY i) FROM generate_series(1, len(p)) g(i))"


def spanned(spark, d):
    return spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id").select("doc_id", F.concat(
        F.lit("Step "), "text", F.lit(" costs $x_"), F.col("doc_id").cast("string"), F.lit("\\$^2$ and \\[y="), (F.col("doc_id") % 7).cast("string"),
        F.lit("\\] then $$z\n$$ [* { id: \"5\" }] end")).alias("src"))


@query("f13_protected_spans", f"WITH {SPANNED} SELECT doc_id, len(regexp_extract_all(src, '{PROT}', 1))::INT AS n_spans, array_to_string(regexp_extract_all(src, '{PROT}', 1), '¦') AS spans FROM spanned")
def f13(spark, d):
    x = spans.protected_spans(F.col("src"))
    return spanned(spark, d).select("doc_id", F.size(x).alias("n_spans"), F.array_join(x, "¦").alias("spans"))


DRAFT = f"""{SPANNED}, tmpl AS (SELECT doc_id, src, {TEMPLATE} AS template FROM (SELECT doc_id, src, regexp_split_to_array(src, '{PROT}') AS p,
   list_transform(regexp_extract_all(src, '{PROT}', 1), lambda x, i: '<M' || (i - 1) || '>') AS f FROM spanned)),
 draft AS (SELECT doc_id, src, template, CASE doc_id % 8 WHEN 0 THEN template WHEN 1 THEN 'ترجمة ' || replace(template, '<M1>', '') WHEN 2 THEN 'ترجمة ' || template || ' 23'
   WHEN 3 THEN ' ' WHEN 4 THEN 'ترجمة ' || replace(template, '<M0>', '<M1>') ELSE 'ترجمة ' || template END AS dr FROM tmpl)"""
RESTORE = f"""rs AS (SELECT doc_id, src, dr, regexp_extract_all(src, '{PROT}', 1) AS sp, list_transform(regexp_extract_all(dr, '<M(\\d+)>', 1), lambda x: x::INT) AS tk FROM draft),
 rt AS (SELECT *, {TEMPLATE.replace('p[i]', 'pp[i]').replace('len(p)', 'len(pp)').replace('f[i]', 'sp[i]').replace('len(f)', 'len(sp)')} AS restored FROM (SELECT *, regexp_split_to_array(dr, '<M\\d+>') AS pp FROM rs)),
 ru AS (SELECT doc_id, restored, CASE WHEN NOT regexp_matches(dr, '\\S') THEN 'empty_translation' WHEN tk <> list_transform(sp, lambda x, i: (i - 1)::INT) THEN 'protected_tokens_mismatch'
  WHEN regexp_extract_all(restored, '{PROT}', 1) <> sp THEN 'protected_spans_changed'
  WHEN regexp_extract_all(src, '\\d+(?:\\.\\d+)?') <> regexp_extract_all(restored, '\\d+(?:\\.\\d+)?') THEN 'numeric_sequence_changed'
  WHEN NOT regexp_matches(restored, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'no_arabic_text' END AS problem FROM rt)"""


def drafts(spark, d):
    t = spanned(spark, d).withColumn("template", spans.to_template(F.col("src")))
    k, ar = F.col("doc_id") % 8, F.lit("ترجمة ")
    dr = F.when(k == 0, F.col("template")).when(k == 1, F.concat(ar, F.replace("template", F.lit("<M1>"), F.lit("")))) \
        .when(k == 2, F.concat(ar, "template", F.lit(" 23"))).when(k == 3, F.lit(" ")) \
        .when(k == 4, F.concat(ar, F.replace("template", F.lit("<M0>"), F.lit("<M1>")))).otherwise(F.concat(ar, "template"))
    return t.withColumn("draft", dr)


@query("f14_placeholder_restore", f"WITH {DRAFT}, {RESTORE} SELECT doc_id, problem, CASE WHEN problem IS NULL THEN restored END AS restored FROM ru")
def f14(spark, d):
    rows = drafts(spark, d).withColumn("problem", spans.restore_problem(F.col("src"), F.col("draft")))
    return rows.select("doc_id", "problem", F.when(F.col("problem").isNull(), spans.restored_text(F.col("src"), F.col("draft"))).alias("restored"))


@query("f15_span_template", f"WITH {DRAFT} SELECT doc_id, template FROM draft")
def f15(spark, d):
    return drafts(spark, d).select("doc_id", "template")


@query("f16_script_check", f"WITH {RESPONSES} SELECT problem_id, language, regexp_matches(generated_response, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic FROM responses")
def f16(spark, d):
    return responses(spark, d).select("problem_id", "language", spans.has_arabic(F.col("generated_response")).alias("arabic"))


@query("f17_comparison_copy", f"""WITH {SPANNED} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN replace(replace(src, '[* {{ id: "5" }}]', ''), 'costs', 'is') ELSE src END AS compared FROM spanned""")
def f17(spark, d):
    rules = F.when(F.col("doc_id") % 10 == 0, F.array(F.struct(F.lit('[* { id: "5" }]').alias("find"), F.lit("").alias("repl")),
                                                      F.struct(F.lit("costs").alias("find"), F.lit("is").alias("repl"))))
    return spanned(spark, d).select("doc_id", spans.apply_rules(F.col("src"), rules).alias("compared"))


@query("f18_group_key", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS group_key FROM documents")
def f18(spark, d):
    return spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id").select("doc_id", digests.group_key(F.col("text"), unicode_form=False).alias("group_key"))


@query("f18_group_key_nfkc", "SELECT doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS group_key FROM documents")
def f18b(spark, d):
    # The texts hold no compatibility characters, so NFC gives the same text as NFKC here.
    return spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id").select("doc_id", digests.group_key(F.col("text")).alias("group_key"))


@query("f19_canonical_digest", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"labels":[' || (doc_id % 3) || ',null],"meta":{"lang":' || to_json(lang)::VARCHAR || ',"none":null},"text":' || to_json(text)::VARCHAR || '}') AS digest FROM documents""")
def f19(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "lang"])
    rows = docs.select("doc_id", "text", F.struct(F.lit(None).cast("string").alias("none"), "lang").alias("meta"),
                       F.array((F.col("doc_id") % 3).cast("int"), F.lit(None).cast("int")).alias("labels"))
    return rows.select("doc_id", digests.canonical_digest(rows).alias("digest"))


@query("f20_raw_row_id", """SELECT event_id, 'trace_' || sha256('{"event_id": ' || event_id || ', "props": {"k": ' || (props->>'k') || '}, "type": "' || event_type || '"}') AS row_id FROM events""")
def f20(spark, d):
    line = F.concat(F.lit('{"type":"'), "event_type", F.lit('",  "props":'), "props", F.lit(',"event_id":'), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events", ["event_id", "event_type", "props"]).select("event_id", digests.raw_row_id(line).alias("row_id"))


@query("f21_labels_and_masks", f"""WITH {TRAJ} SELECT doc_id, array_to_string(list_transform(ratings, lambda r: CASE WHEN r = 1 THEN '1' WHEN r = -1 THEN '0' ELSE '-' END), ',') AS labels,
 array_to_string(list_transform(ratings, lambda r: (r <> 0)::INT::VARCHAR), ',') AS mask FROM traj""")
def f21(spark, d):
    r = F.col("source_step_ratings")
    return trajectories(spark, d).select("doc_id", F.array_join(F.transform(S.labels_from_ratings(r), lambda x: x.cast("string")), ",", "-").alias("labels"),
                                         F.array_join(F.transform(S.mask_from_ratings(r), lambda x: x.cast("string")), ",").alias("mask"))


@query("f22_step_text", r"""SELECT page_id, array_to_string(list_transform(string_split(html, '>'), lambda s: regexp_replace(s, '[\r\n]+', ' ', 'g')), chr(10)) AS response,
 len(string_split(array_to_string(list_transform(string_split(html, '>'), lambda s: regexp_replace(s, '[\r\n]+', ' ', 'g')), chr(10)), chr(10)))::INT AS n_steps FROM pages""")
def f22(spark, d):
    joined = S.steps_to_text(F.split("html", ">", -1))
    return table(spark, d, "pages", ["page_id", "html"]).select("page_id", joined.alias("response"), F.size(S.split_steps(joined)).alias("n_steps"))


@query("f23_trimmed_lines", r"""SELECT page_id, len(list_filter(list_transform(string_split(html, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))::INT AS n_lines,
 array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), '|') AS lines FROM pages""")
def f23(spark, d):
    x = S.trimmed_lines(F.col("html"))
    return table(spark, d, "pages", ["page_id", "html"]).select("page_id", F.size(x).alias("n_lines"), F.array_join(x, "|").alias("lines"))


COVER = """'length:' || CASE WHEN n <= 4 THEN 'short' WHEN n <= 12 THEN 'medium' ELSE 'long' END || '/first_error:' ||
 CASE WHEN first_error IS NULL THEN 'none' WHEN first_error <= 4 THEN 'early' WHEN first_error <= 12 THEN 'middle' ELSE 'late' END || '/neutral:' || CASE WHEN list_contains(ratings, 0) THEN 'True' ELSE 'False' END"""


@query("f24_coverage_labels", f"WITH {TRAJ} SELECT doc_id, {COVER} AS labels FROM traj")
def f24(spark, d):
    return trajectories(spark, d).select("doc_id", F.array_join(S.coverage_labels(F.size("steps"), F.col("first_error_step"), F.col("source_step_ratings")), "/").alias("labels"))


@query("f25_supervision", f"""WITH {TRAJ}, u AS (SELECT doc_id, unnest(ratings) AS r, generate_subscripts(ratings, 1) - 1 AS i FROM traj)
SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices, string_agg((r = 1)::INT::VARCHAR, ',' ORDER BY i) AS targets FROM u WHERE r <> 0 GROUP BY 1""")
def f25(spark, d):
    rows = trajectories(spark, d).where(S.supervision_valid(F.col("step_labels"), F.col("supervision_mask")))
    return rows.select("doc_id", F.array_join(S.supervised_indices(F.col("supervision_mask")).cast("array<string>"), ",").alias("indices"),
                       F.array_join(S.supervised_targets(F.col("step_labels"), F.col("supervision_mask")).cast("array<string>"), ",").alias("targets"))


@query("f26_logit_probability", """SELECT vec_id, round(1/(1+exp(-embedding[1]::DOUBLE)),6) AS probability, round(exp(embedding[2]::DOUBLE)/(exp(embedding[1]::DOUBLE)+exp(embedding[2]::DOUBLE)),6) AS pair_probability,
 array_to_string(list_transform(list_filter(embedding, lambda x, i: i % 4 = 0), lambda x: (x > 0)::INT::VARCHAR), ',') AS flagged_signs FROM embeddings""")
def f26(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    flags = F.transform("embedding", lambda x, i: ((i + 1) % 4 == 0).cast("int"))
    signs = F.transform(S.flagged_rewards(F.col("e"), F.col("flags")), lambda x: (x > 0).cast("int").cast("string"))
    rows = table(spark, d, "embeddings").withColumn("e", e).withColumn("flags", flags)
    return shown(rows.select("vec_id", S.logit_to_probability(F.col("e")[0]).alias("probability"), S.pair_probability(F.col("e")[0], F.col("e")[1]).alias("pair_probability"),
                             F.array_join(signs, ",").alias("flagged_signs")))


@query("f27_masked_bce", f"""WITH {TRAJ}, u AS (SELECT doc_id, unnest(ratings) AS r, ((length(unnest(steps)) % 13) - 6)::DOUBLE / 3 AS x FROM traj)
SELECT doc_id, round(avg(greatest(x, 0) - x * (r = 1)::INT + ln(1 + exp(-abs(x)))), 6) AS loss FROM u WHERE r <> 0 GROUP BY 1""")
def f27(spark, d):
    logits = F.transform("steps", lambda s: ((F.length(s) % 13) - 6).cast("double") / 3)
    rows = trajectories(spark, d).withColumn("loss", S.masked_bce(logits, F.col("step_labels"), F.col("supervision_mask")))
    return shown(rows.where("loss IS NOT NULL").select("doc_id", "loss"))


@query("f28_text_validity", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2026-02-3' || (doc_id % 10) WHEN doc_id % 3 = 1 THEN '2026-01-1' || (doc_id % 10) ELSE lang END AS day,
  CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE upper(sha256(text)) END AS dig, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE source END AS txt FROM documents)
SELECT doc_id, regexp_matches(day, '^\d{4}-\d{2}-\d{2}$') AND try_cast(day AS DATE) IS NOT NULL AS valid_date, regexp_full_match(dig, '[0-9a-f]{64}') AS valid_digest, regexp_matches(txt, '\S') AS filled FROM t""")
def f28(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "lang", "source"])
    i = F.col("doc_id")
    day = F.when(i % 3 == 0, F.concat(F.lit("2026-02-3"), (i % 10).cast("string"))).when(i % 3 == 1, F.concat(F.lit("2026-01-1"), (i % 10).cast("string"))).otherwise(F.col("lang"))
    dig = F.when(i % 2 == 0, F.sha2("text", 256)).otherwise(F.upper(F.sha2("text", 256)))
    return docs.select("doc_id", X.is_iso_date(day).alias("valid_date"), X.is_digest(dig).alias("valid_digest"),
                       X.is_filled(F.when(i % 4 == 0, "  ").otherwise(F.col("source"))).alias("filled"))


@query("f29_array_text", """SELECT vec_id, array_to_string(list_transform(embedding[1:3], lambda x: printf('%.2f', (round(x::DOUBLE * 64) / 4) + 0.0)), ' ') AS scores, round(list_sum(list_transform(embedding[1:3], lambda x: round(x::DOUBLE * 64) / 4)), 6) AS total,
 '["' || label || '","x"]' AS as_json, label || '|x' AS joined FROM embeddings""")
def f29(spark, d):
    rows = table(spark, d, "embeddings").withColumn("s", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double") * 64) / 4 + F.lit(0.0))) \
        .withColumn("t", X.scores_to_text(F.col("s"), 2)).withColumn("a", F.array(F.col("label").cast("string"), F.lit("x")))
    back = F.aggregate(X.text_to_scores(F.col("t")), F.lit(0.0), lambda acc, x: acc + x)
    return shown(rows.select("vec_id", F.col("t").alias("scores"), back.alias("total"), X.array_to_json(X.json_to_array(X.array_to_json(F.col("a")))).alias("as_json"),
                             X.joined(X.split_joined(X.joined(F.col("a")))).alias("joined")))


@query("f30_prompt_text", f"""WITH {RESPONSES} SELECT problem_id, language, CASE language WHEN 'english' THEN 'Solve the problem.' || chr(10) || 'FINAL ANSWER: <number>' || chr(10) || txt
 WHEN 'arabic' THEN 'حل المسألة.' || chr(10) || 'الإجابة النهائية: <number>' || chr(10) || txt END AS prompt FROM responses""")
def f30(spark, d):
    templates = {"english": "Solve the problem.\nFINAL ANSWER: <number>\n{question}", "arabic": "حل المسألة.\nالإجابة النهائية: <number>\n{question}"}
    return X.with_prompt(responses(spark, d), templates, "language", "txt").select("problem_id", "language", "prompt")


@query("w05_first_position", f"WITH {TRAJ} SELECT doc_id, first_error::INT AS first_error FROM traj")
def w05(spark, d):
    return trajectories(spark, d).select("doc_id", S.first_position(F.col("source_step_ratings"), F.lit(-1)).alias("first_error"))

"""What models answer, in all the forms that recovery must tell apart.

Every conversation turn is answered in each form; the record, or that there is none, follows from
the form and the turn, so SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions.model_output import parse_decision, parse_verdict
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import read_table

BASE = '{"detected_language": "en", "intent": "order_status"'


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def decision_forms(text, role):
    """Raw outputs by form, and whether they hold a record."""
    record = F.to_json(F.struct(F.lit("en").alias("detected_language"), F.lit("order_status").alias("intent"), text.alias("draft_reply")))
    other = F.to_json(F.struct(F.lit("en").alias("detected_language"), F.lit("weather").alias("intent"), text.alias("draft_reply")))
    return {
        "clean": record,
        "fenced": F.concat(F.lit("Here it is:\n```json\n"), record, F.lit("\n```\nDone.")),
        "prose": F.concat(F.lit("Sure! "), record, F.lit(" Hope this helps")),
        "blanks": F.concat(F.lit("\n\t "), record, F.lit(" \r\n")),
        "two_objects": F.concat(record, F.lit(" "), record),
        "closed_early": F.concat(record, F.lit("]}")),
        "bad_enum": other,
        "null_field": F.lit(BASE + ', "decision": null}'),
        "wrong_type": F.lit(BASE + ', "draft_reply": 5}'),
        "half_surrogate": F.lit(BASE + ', "draft_reply": "a\\ud83d"}'),
        "whole_surrogates": F.lit(BASE + ', "draft_reply": "\\ud83d\\ude00 \\\\ud83d"}'),
        "extra_and_lists": F.concat(F.lit(BASE + ', "decision": "ESCALATE", "more": [1, {"a": null}], "rag_snippets": ["x", "'), role, F.lit('"]}')),
        "mixed_list": F.lit(BASE + ', "rag_snippets": ["x", 1]}'),
        "long_reply": F.to_json(F.struct(F.lit("en").alias("detected_language"), F.lit("order_status").alias("intent"),
                                         F.repeat(text, 4).alias("draft_reply"))),
        "no_json": F.concat(F.lit("I cannot help with: "), F.translate(text, "{}[]", "")),
        "nothing": F.lit(None).cast("string"),
    }


DECISION_FORMS_SQL = """
WITH f AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, unnest(['clean', 'fenced', 'prose', 'blanks', 'two_objects', 'closed_early',
             'bad_enum', 'null_field', 'wrong_type', 'half_surrogate', 'whole_surrogates', 'extra_and_lists', 'mixed_list', 'long_reply',
             'no_json', 'nothing']) AS form FROM conversations),
r AS (SELECT *, CASE WHEN form IN ('clean', 'fenced', 'prose', 'blanks') THEN t WHEN form = 'long_reply' THEN repeat(t, 4)
                     WHEN form = 'whole_surrogates' THEN chr(128512) || ' \\ud83d' WHEN form = 'extra_and_lists' THEN '' END AS reply FROM f),
v AS (SELECT *, coalesce(length(reply) <= 500, false) AS ok FROM r)
SELECT conv_id, turn, form, CASE WHEN ok THEN 'en' END AS detected_language, CASE WHEN ok THEN 'order_status' END AS intent,
       CASE WHEN ok THEN CASE form WHEN 'extra_and_lists' THEN 'ESCALATE' ELSE 'AUTO_REPLY' END END AS decision,
       CASE WHEN ok THEN 'NONE' END AS escalation_reason, CASE WHEN ok THEN md5(reply) END AS reply_md5,
       CASE WHEN ok THEN CASE form WHEN 'extra_and_lists' THEN 'x,' || role ELSE '' END END AS snippets,
       CASE WHEN form = 'nothing' THEN 'empty model output' WHEN NOT ok THEN 'could not parse model output' END AS error
FROM v"""


@query("model_decision_forms", DECISION_FORMS_SQL, covers=["D6", "D7"])
def model_decision_forms(spark, sf_dir):
    forms = decision_forms(F.coalesce("text", F.lit("")), F.col("role"))
    d = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.array(*[
        F.struct(F.lit(name).alias("form"), raw.alias("raw")) for name, raw in forms.items()])).alias("x")).select("conv_id", "turn", "x.*")
    p = d.select("conv_id", "turn", "form", parse_decision("raw").alias("p"))
    v = F.col("p.value")
    return p.select("conv_id", "turn", "form", v["detected_language"].alias("detected_language"), v["intent"].alias("intent"),
                    v["decision"].alias("decision"), v["escalation_reason"].alias("escalation_reason"),
                    F.md5(v["draft_reply"]).alias("reply_md5"), F.when(v.isNotNull(), F.concat_ws(",", v["rag_snippets"])).alias("snippets"),
                    F.regexp_extract("p.error", "^[^;]*", 0).alias("error"))


# form: (score, pii_safety_pass, language_match_pass as JSON, whether valid with its score and booleans)
VERDICT_FORMS = {
    "integers": ("3", "true", "false", (3, True, False)), "digits": ('" 4 "', '"yes"', '"OFF"', (4, True, False)),
    "whole_double": ("5.0", "1", "0.0", (5, True, False)), "exponent": ("2e0", '"T"', '" n "', (2, True, False)),
    "boolean_score": ("true", "true", "true", (1, True, True)), "part": ("4.5", "true", "true", None),
    "low": ("0", "true", "true", None), "high": ("6", "true", "true", None), "words": ('"four"', "true", "true", None),
    "bad_word": ("3", '"maybe"', "true", None), "two": ("3", "2", "true", None), "null": ("3", "null", "true", None),
    "huge": ("1e400", "true", "true", None), "list": ("[3]", "true", "true", None),
}


def _verdict_sql() -> str:
    rows = ", ".join(f"('{name}', {str(ok is not None).lower()}, {ok[0] if ok else 'NULL'}, {str(ok[1]).lower() if ok else 'NULL'}, "
                     f"{str(ok[2]).lower() if ok else 'NULL'})" for name, (_, _, _, ok) in VERDICT_FORMS.items())
    return f"""
SELECT conv_id, turn, form, CAST(score AS INTEGER) AS brand_voice_score, CASE WHEN ok THEN md5(coalesce(text, '')) END AS justification_md5,
       CASE WHEN ok THEN CAST(1 + turn % 5 AS INTEGER) END AS factual_policy_adherence,
       CAST(pii AS BOOLEAN) AS pii_safety_pass, CAST(lang AS BOOLEAN) AS language_match_pass
FROM conversations, (VALUES {rows}) f(form, ok, score, pii, lang)"""


@query("model_verdict_forms", _verdict_sql(), covers=["J3"])
def model_verdict_forms(spark, sf_dir):
    def raw(score, pii, lang):
        why = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("brand_voice_justification")))
        return F.concat(F.lit(f'{{"brand_voice_score": {score}, "pii_safety_pass": {pii}, "language_match_pass": {lang}, '
                              '"factual_policy_adherence": '), (1 + F.col("turn") % 5).cast("string"), F.lit(", "), F.substring(why, 2, 1 << 30))

    d = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.array(*[
        F.struct(F.lit(name).alias("form"), raw(*x[:3]).alias("raw")) for name, x in VERDICT_FORMS.items()])).alias("x")).select("conv_id", "turn", "x.*")
    v = parse_verdict("raw")["value"]
    d = d.select("conv_id", "turn", "form", v.alias("v"))
    return d.select("conv_id", "turn", "form", "v.brand_voice_score", F.md5("v.brand_voice_justification").alias("justification_md5"),
                    "v.factual_policy_adherence", "v.pii_safety_pass", "v.language_match_pass")

"""Which category a message has and how sure that is: a rule, given answers,
keywords; a critic that weighs a second answer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import documents

CATEGORIES = ("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM")
#: Confidence below which an answer is unsure, and that of one kept against another.
UNSURE_BELOW = 0.8
CONTESTED = 0.5
# Words for a confidence, and the least number of each tier.
TIER_WORDS = {1.0: ("high", "very high"), 0.85: ("medium", "med"), 0.65: ("moderate",), 0.5: ("low", "very low")}
TIER_FROM = {1.0: 0.9, 0.85: 0.75, 0.65: 0.6}
UNKNOWN_TIER = 0.85
# Words that ask for credentials, and that mark automatic replies.
CREDENTIALS = (
    "log in", "login", "passcode", "password", "sign in", "signin", "verify your account", "verify your e-mail", "verify your email", "verify your identity", "verify your mail",
)
AUTOMATIC = ("auto-reply", "automatic reply", "autoreply", "out of office", "out of the office", "undeliverable")
# Domains that only send spam.
SPAM_DOMAINS = ("crypto-invest.net", "logistics-deals.biz", "parcel-track.co", "prize-claims.info", "secure-mailbox.org", "webmail-verify.co")
# Phrases of bodies that tell a category, the first that occurs counts.
BODY_PHRASES = (
    ("Attached are the SI and draft BL", "BL_COMPARISON"),
    ("attached the shipping instruction and the draft bill of lading", "BL_COMPARISON"),
    ("check the draft BL against the SI", "BL_COMPARISON"),
    ("Please compare the SI and draft BL", "BL_COMPARISON"),
    ("Attached SI and draft BL", "BL_COMPARISON"),
    ("attached the SI and the", "BL_COMPARISON"),
    ("Please find Shipping instruction", "SI_REQUEST"),
    ("send the draft BL", "SI_REQUEST"),
    ("D&D / detention charges", "INVOICE_QUERY"),
    ("GR is still missing for invoice", "INVOICE_QUERY"),
    ("Query on invoice", "INVOICE_QUERY"),
    ("Requesting to cancel invoice", "INVOICE_QUERY"),
    ("daily berthing report", "GENERAL"),
)


def confidence_tier(said: Column) -> Column:
    """The tier of a confidence given as a word or a number; unknown words get
    UNKNOWN_TIER, null stays null."""
    x = F.lower(F.trim(said.cast("string")))
    number = x.try_cast("double")
    by_number = F.when(number.isNull(), UNKNOWN_TIER)
    for tier, least in TIER_FROM.items():
        by_number = by_number.when(number >= least, tier)
    out = by_number.otherwise(min(TIER_WORDS))
    for tier, words in TIER_WORDS.items():
        out = F.when(x.isin(*words), tier).otherwise(out)
    return F.when(said.isNotNull(), out)


def roles_of(paths: Column) -> Column:
    """The roles that the names of an array of paths tell, in order."""
    return F.filter(F.transform(paths, lambda p: F.upper(F.regexp_extract(F.substring_index(p, "/", -1), r"(?i)_(SI|BL)(?=[._])", 1))), lambda r: r != "")


def files_for(paths: Column, role: str) -> Column:
    """The paths of an array whose name tells the role."""
    return F.filter(paths, lambda p: F.substring_index(p, "/", -1).rlike(rf"_{role}[._\s(-]") | F.upper(p).endswith(role))


def has_si_and_bl(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(roles_of(paths))) == F.array(F.lit("BL"), F.lit("SI"))


def has_complete_pair(paths: Column) -> Column:
    """Some SI and BL of the paths have names that agree but for the role."""
    mark = r"_(?:SI|BL)(?=[._\s(-])"
    name = lambda p: F.substring_index(p, "/", -1)
    role = lambda p: F.regexp_extract(name(p), r"_(SI|BL)(?=[._\s(-])", 1)
    key = lambda p: F.regexp_replace(F.regexp_replace(name(p), rf"^(.*?){mark}", "$1"), r"\.[^.]*$", "")
    keys = lambda r: F.transform(F.filter(paths, lambda p: role(p) == r), key)
    return F.arrays_overlap(keys("SI"), keys("BL"))


def body_category(address: Column, body: Column) -> Column:
    """Struct (category, evidence) from a sender's domain or a phrase of the
    body as it stands there; null and `no rule` where neither tells."""
    domain = F.substring_index(address, "@", -1)
    made = lambda category, evidence: F.struct(F.lit(category).cast("string").alias("category"), evidence.alias("evidence"))
    out = made(None, F.lit("no rule"))
    low = F.lower(F.coalesce(body, F.lit("")))
    for phrase, category in reversed(BODY_PHRASES):
        out = F.when(low.contains(phrase.lower()), made(category, F.lit(f"says: {phrase}"))).otherwise(out)
    return F.when(domain.isin(*SPAM_DOMAINS), made("SPAM", F.concat(F.lit("known spam domain "), domain))).otherwise(out)


def sorted_by(complete: Column, answer: Column, answer_confidence: Column, subject: Column, body: Column, n_attachments: Column) -> Column:
    """Struct (category, decided_by, confidence): a complete pair decides by
    rule, else the given answer, else keywords."""
    made = lambda category, by, sure: F.struct(category.alias("category"), F.lit(by).alias("decided_by"), sure.cast("double").alias("confidence"))
    by_words = documents.fallback_category(F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")), n_attachments)
    return (
        F.when(complete, made(F.lit("BL_COMPARISON"), "rule", F.lit(1.0)))
        .when(answer.isNotNull(), made(answer, "llm", F.coalesce(answer_confidence, F.lit(UNKNOWN_TIER))))
        .otherwise(made(by_words, "rule", F.lit(CONTESTED)))
    )


def classify(messages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """messages (email_id, from, subject, body, attachments) with category,
    decided_by and confidence. answers: email_id, category and confidence, as
    a model gave them; other categories than the known count as no answer."""
    if answers is None:
        held = messages.withColumns({"_answer": F.lit(None).cast("string"), "_sure": F.lit(None).cast("double")})
    else:
        known = answers.where(F.col("category").isin(*CATEGORIES)).groupBy("email_id").agg(F.max_by("category", confidence_tier(F.col("confidence"))).alias("_answer"), F.max(confidence_tier(F.col("confidence"))).alias("_sure"))
        held = messages.join(known, "email_id", "left")
    paths = F.coalesce("attachments", F.array().cast("array<string>"))
    found = sorted_by(F.coalesce(has_complete_pair(paths), F.lit(False)), F.col("_answer"), F.col("_sure"), F.col("subject"), F.col("body"), F.size(paths))
    return held.withColumn("_c", found).select(*messages.columns, "_c.*")


def _doubt(holds: Column, reason: str, confirmed: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.coalesce(confirmed, F.lit(False)).alias("confirmed")))


def doubts(category: Column, confidence: Column, subject: Column, body: Column, attachments: Column, second: Column) -> Column:
    """Why an answer may be wrong: structs (reason, whether the second answer
    bears it out), in a fixed order; empty where nothing is in doubt."""
    text = F.concat_ws("\n", subject, body)
    said = lambda words: text.rlike(documents.phrase_pattern([documents.Phrase(w) for w in words]))
    found = F.array(
        _doubt(confidence < UNSURE_BELOW, "unsure", F.lit(False)),
        _doubt((category != "BL_COMPARISON") & has_si_and_bl(attachments), "pair attached, not filed as a comparison", second == "BL_COMPARISON"),
        _doubt((category != "SPAM") & said(CREDENTIALS) & (F.lower(text).contains("http://") | F.lower(text).contains("https://")), "asks for credentials beside a link", second == "SPAM"),
        _doubt((category == "BL_COMPARISON") & said(AUTOMATIC), "reads like an automatic reply", second != "BL_COMPARISON"),
    )
    return F.filter(found, lambda d: d.isNotNull())


def review(both: DataFrame) -> DataFrame:
    """both (subject, body, attachments, category, confidence, second_category,
    second_confidence; null where nobody was asked) with kept, kept_confidence
    and outcome. Equal answers keep the surer confidence, the first's on a tie;
    the second wins if it bears a doubt out or is surer than an unsure first;
    else the first stays, contested."""
    first, sure, second, second_sure = (F.col(c) for c in ("category", "confidence", "second_category", "second_confidence"))
    held = both.withColumn("doubts", doubts(first, sure, F.col("subject"), F.col("body"), F.col("attachments"), second))
    outcome = (
        F.when((F.size("doubts") == 0) | second.isNull(), "unasked")
        .when(first == second, "agreed")
        .when(F.exists("doubts", lambda d: d["confirmed"]) | ((sure < UNSURE_BELOW) & (second_sure > sure)), "changed")
        .otherwise("contested")
    )
    held = held.withColumn("outcome", outcome)
    is_ = lambda x: F.col("outcome") == x
    kept = F.when(is_("changed"), second).otherwise(first)
    by = F.when(is_("agreed"), F.greatest(sure, second_sure)).when(is_("changed"), second_sure).when(is_("contested"), CONTESTED).otherwise(sure)
    return held.withColumns({"kept": kept, "kept_confidence": by})


def asked(rows: DataFrame, prompt: Column, model: Callable[[str], str | None], name: str = "answer") -> DataFrame:
    """rows with what a model answers to prompt: any callable from text to text
    (a model, or a stub), made in the workers, a null prompt unasked. An
    exception is no answer. Ask only the rows that need it: filter first."""
    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return model(text)
            except Exception:  # noqa: BLE001  no answer, whatever failed
                return None

        return texts.map(one)

    return rows.withColumn(name, ask(prompt))


def disagreements(saved: DataFrame) -> DataFrame:
    """saved (email_id, subject, body, attachments, category, confidence): one
    row with the total, how many the keywords file alike and how many are
    unsure."""
    by_words = documents.fallback_category(F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")), F.size(F.coalesce("attachments", F.array().cast("array<string>"))))
    return saved.agg(F.count("*").alias("total"), F.count_if(by_words == F.col("category")).alias("agree"), F.count_if(F.col("confidence") < UNKNOWN_TIER).alias("unsure"))


def hand_label_accuracy(classified: DataFrame, labels: DataFrame, undecided: str = "AMBIGUOUS") -> DataFrame:
    """One row: labelled, correct, ambiguous, of ids in both (email_id,
    category; email_id, label). Undecided labels count apart."""
    both = classified.join(labels, "email_id")
    decided = F.col("label") != undecided
    return both.agg(F.count_if(decided).alias("labelled"), F.count_if(decided & (F.col("label") == F.col("category"))).alias("correct"), F.count_if(~decided).alias("ambiguous"))

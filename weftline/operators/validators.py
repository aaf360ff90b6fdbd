"""Validators: each gives rows (conversation_id, validator, axis, verdict, score), in one scan without a shuffle.

The n-gram validator counts inside each row, by sorted hashes of the runs.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.language import LanguageModel, detect

# Manglish particles and shortcuts that formal Malay forbids.
PARTICLES = ["lah", "lor", "leh", "meh", "kot", "wei", "doh", "weh", "eh", "mah", "deh", "geh", "bah"]
SHORTCUTS = ["tak", "je", "dah", "mcm", "byk", "dgn", "pd", "utk", "yg", "tu", "ni", "kt", "sbb", "skrg", "jgn", "tgk", "btw", "tq", "thx"]
# English words that telecommunications texts in Malay may use.
TELCO_LOANWORDS = [
    "router", "modem", "bil", "bandwidth", "internet", "wifi", "fiber", "fibre",
    "broadband", "hotspot", "data", "sim", "kuota", "plan", "package", "billing",
    "portal", "login", "password", "username", "email", "sms",
]
# Frequent Malay words that look like English ones to a rule on letters.
MALAY_WORDS = [
    "saya", "anda", "kamu", "awak", "kita", "kami", "mereka", "dia", "ia",
    "dan", "atau", "tetapi", "namun", "kerana", "sebab", "supaya", "agar",
    "untuk", "kepada", "daripada", "dari", "pada", "dalam", "atas", "bawah",
    "antara", "tanpa", "dengan", "oleh", "tentang", "mengenai",
    "ini", "itu", "sini", "situ", "begitu", "begini", "demikian",
    "yang", "adalah", "ialah", "merupakan", "akan", "sudah", "telah",
    "sedang", "masih", "belum", "sangat", "amat", "terlalu", "lebih",
    "kurang", "paling", "agak", "cukup", "hanya", "sahaja", "saja",
    "juga", "pun", "lagi", "pula", "kembali", "semula",
    "ada", "tiada", "membuat", "buat", "membantu", "bantu",
    "menggunakan", "guna", "memberi", "beri", "menerima", "terima",
    "menyemak", "semak", "menghantar", "hantar", "menjawab", "jawab",
    "memohon", "mohon", "mendapat", "dapat", "berikan", "lakukan",
    "menjadi", "jadi", "datang", "pergi", "pulang", "masuk", "keluar",
    "naik", "turun", "buka", "tutup", "log", "selesai", "siap",
    "selamat", "sejahtera", "kasih", "sila", "silakan",
    "tolong", "harap",
    "pelanggan", "akaun", "perkhidmatan", "perkara", "masalah", "soalan",
    "jawapan", "maklumat", "butiran", "permohonan", "pertanyaan",
    "pasukan", "syarikat", "pejabat", "kawasan",
    "hari", "tarikh", "waktu", "masa", "minggu", "bulan", "tahun",
    "tidak", "bukan", "mustahil", "boleh", "mungkin", "harus", "perlu",
    "mesti", "wajib",
    "apa", "siapa", "mana", "bila", "bagaimana", "mengapa", "kenapa",
    "berapa", "manakah", "sekiranya", "jika", "andai",
    "iaitu", "yakni", "umpamanya", "antaranya", "termasuk",
]
# The profile that new projects begin with.
CASUAL_MALAYSIAN = {
    "primary": "ms", "script": "latin", "policy": "intra-sentential", "rate": 0.4, "register": "colloquial", "allow_particles": True,
    "require_formal_malay": False, "loanwords": "free", "formality": "colloquial",
}
MAX_CHARS = 50_000


def is_known_malay(word: Column) -> Column:
    """Whether a word is one of `MALAY_WORDS`, in either case; null is not."""
    return F.coalesce(F.lower(word).isin(*MALAY_WORDS), F.lit(False))


def loanwords(text: Column, allowed: tuple[str, ...] | list[str] = (), known: tuple[str, ...] | list[str] = MALAY_WORDS) -> Column:
    """Words of three or more plain letters that are neither allowed nor known, in order and as often as they stand there."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-zÀ-ÿĀ-ɏ]+"), F.lit(0))
    skip = sorted({w.lower() for w in (*allowed, *known)})
    foreign = lambda w: w.rlike(r"^[A-Za-z]{3,}$") & (~F.lower(w).isin(*skip) if skip else F.lit(True))
    return F.filter(tokens, foreign)


def word_hits(text: Column, listed: list[str]) -> Column:
    """All listed words in a text, lower-cased, as often as they stand there, at word bounds."""
    words = "|".join(re.escape(w) for w in sorted({w.lower() for w in listed}))
    bare = r"(?<![\p{L}\p{N}_])(" + words + r")(?![\p{L}\p{N}_])"
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + bare), F.lit(1)), F.lower)


def _row(kind: str, axis: str, verdict: Column | str, score: Column | None = None, reason: Column | str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("validator"), F.lit(axis).alias("axis"), as_column(verdict).alias("verdict"),
        (F.lit(None) if score is None else score).cast("double").alias("score"), as_column(reason).cast("string").alias("reason"),
    )


def schema_rule(text: Column) -> Column:
    """Empty after trimming: fail; longer than 50,000 characters: warn; else pass with score 1."""
    empty = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "") == ""
    long = F.length(text) > MAX_CHARS
    return F.array(
        F.when(empty, _row("schema", "correctness", "fail", None, "empty_response"))
        .when(long, _row("schema", "correctness", "warn", None, "length"))
        .otherwise(_row("schema", "correctness", "pass", F.lit(1.0)))
    )


def language_rule(detected: Column, primary: Column, policy: Column, confidence: Column) -> Column:
    """Detected against wanted language: near relatives and allowed code switching only warn."""
    mixed = policy.isin("intra-sentential", "rojak", "inter-sentential") & detected.isin("en", "zh", "ta")
    relatives = detected.isin("ms", "id") & primary.isin("ms", "id")
    verdict = F.when(detected.isNull(), "warn").when(detected == primary, "pass").when(mixed | relatives, "warn").otherwise("fail")
    return F.array(_row("langid", "language-fidelity", verdict, confidence, F.when(detected.isNull(), "no_detection")))


def register_rule(
    text: Column, primary: Column, allow_particles: Column, formal: Column, banned: list[str] | None = None,
    patterns: tuple[str, ...] = (), policy: Column | None = None, allowed: tuple[str, ...] | list[str] = (), known: tuple[str, ...] | list[str] = MALAY_WORDS,
) -> Column:
    """Banned words, banned patterns, formal spelling and loanwords; every breach is a row, no breach a pass.

    `policy` says what loanwords are: with forbid they fail, with allowlist those that are not `allowed` warn; of them the first ten are named.
    """
    kind = ("register-compliance", "register")
    banned = PARTICLES if banned is None else banned
    rows = []
    if banned:
        rows.append(F.when((F.size(word_hits(text, banned)) > 0) & ~allow_particles, _row(*kind, "fail", None, "banned_particles")))
    rows += [F.when(text.rlike("(?i)" + p), _row(*kind, "fail", None, "banned_pattern")) for p in patterns if _compiles(p)]
    rows.append(F.when((primary == "ms") & formal & (F.size(word_hits(text, SHORTCUTS)) > 0), _row(*kind, "fail", None, "formal_malay_shortcut")))
    if policy is not None:
        foreign = loanwords(text, allowed, known)
        asked = (primary != "en") & policy.isin("forbid", "allowlist") & (F.size(foreign) > 0)
        rows.append(F.when(asked, _row(*kind, F.when(policy == "forbid", "fail").otherwise("warn"), None, F.concat(F.lit("english_loanwords "), F.array_join(F.slice(foreign, 1, 10), " ")))))
    found = F.filter(F.array(*rows), F.isnotnull)
    return F.when(F.size(found) == 0, F.array(_row(*kind, "pass", F.lit(1.0)))).otherwise(found)


def _compiles(pattern: str) -> bool:
    """Whether Spark's own expressions take the pattern; those that they do not take are passed over."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def repetition(texts: DataFrame, n: int = 5, threshold: float = 0.3) -> DataFrame:
    """Rows (conversation_id, verdict, score, ratio, gram, times, grams) from (conversation_id, text).

    The share of the most frequent of a text's n-word runs: above 0.5 fails, above the threshold warns. Fewer than 30
    words pass with score 1. Of equally frequent runs, the one seen first is named. Runs are told apart by 64-bit hashes.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    none = F.array().cast("array<bigint>")
    rows = texts.select("conversation_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    # Generators hold what lies below them fixed: each array is made once, not once per use.
    rows = rows.select("conversation_id", F.inline(F.array(F.struct("words"))))
    hashes = F.transform(F.slice("words", 1, F.size("words") - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get("words", i + k) for k in range(1, n)]))
    rows = rows.select("conversation_id", "words", F.inline(F.array(F.struct(F.when(F.size("words") >= 30, hashes).otherwise(none).alias("h")))))
    # Longs that hold a hash's high bits over its place in the low ones sort fast; equal neighbours are compared whole.
    bits = F.length(F.bin(F.size("h")))
    packed = "sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i AS bigint)))"
    several = F.size("h") > F.size(F.array_distinct("h"))
    rows = rows.withColumn("b", bits).select("conversation_id", "words", "h", "b", F.inline(F.array(F.struct(F.when(several, F.expr(packed)).alias("placed")))))
    twice = "filter(placed, (x, i) -> coalesce(shiftright(x, b) = shiftright(get(placed, i - 1), b), false) OR coalesce(shiftright(x, b) = shiftright(get(placed, i + 1), b), false))"
    rows = rows.withColumn("placed", F.expr(twice))
    zero = F.lit(0)
    start = F.struct(F.lit(None).cast("long").alias("x"), zero.alias("run"), zero.alias("begin"), F.lit(1).alias("times"), zero.alias("first"))

    def step(s: Column, e: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), "b") - 1
        upper = lambda x: F.call_function("shiftright", x, "b")
        place = e.bitwiseAND(mask).cast("int")
        again = F.coalesce((upper(s["x"]) == upper(e)) & (F.get("h", s["x"].bitwiseAND(mask).cast("int")) == F.get("h", place)), F.lit(False))
        run, begin = F.when(again, s["run"] + 1).otherwise(1), F.when(again, s["begin"]).otherwise(place)
        first = F.when(run > s["times"], begin).when(run == s["times"], F.least(begin, s["first"])).otherwise(s["first"])
        return F.struct(e.alias("x"), run.alias("run"), begin.alias("begin"), F.greatest(run, s["times"]).alias("times"), first.alias("first"))

    best = F.coalesce(F.aggregate("placed", start, step), start)
    rows = rows.select("conversation_id", "words", F.size("h").cast("long").alias("grams"), F.inline(F.array(best)))
    times = F.when(F.col("grams") > 0, F.col("times")).otherwise(0).cast("long")
    ratio = F.try_divide(times, F.col("grams"))
    verdict = F.when(F.col("grams") == 0, "pass").when(ratio > 0.5, "fail").when(ratio > threshold, "warn").otherwise("pass")
    warned = F.coalesce(ratio > threshold, F.lit(False))
    return rows.select(
        "conversation_id", verdict.alias("verdict"), F.coalesce(1 - ratio, F.lit(1.0)).alias("score"), F.round(ratio, 3).alias("ratio"),
        F.when(warned, F.array_join(F.slice("words", F.col("first") + 1, n), " ")).alias("gram"), times.alias("times"), "grams",
    )


def with_language(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """`texts` with detected and confidence; both null where a text has no letters."""
    found = texts.withColumn("__found", detect(F.col("text"), model))
    return found.withColumns({"detected": F.col("__found.language"), "confidence": F.col("__found.confidence")}).drop("__found")


def run_validators(texts: DataFrame, primary: str = "ms", policy: str = "none", allow_particles: bool = False, formal: bool = True) -> DataFrame:
    """All four validators over (conversation_id, text, detected, confidence): a union of rows, none cut short by another."""
    lit = F.lit
    rules = F.concat(
        schema_rule(F.col("text")),
        language_rule(F.col("detected"), lit(primary), lit(policy), F.col("confidence")),
        register_rule(F.coalesce("text", lit("")), lit(primary), lit(allow_particles), lit(formal)),
    )
    rows = texts.select("conversation_id", F.inline(rules))
    grams = repetition(texts).select("conversation_id", lit("ngram-repetition").alias("validator"), lit("naturalness").alias("axis"), "verdict", "score", lit(None).cast("string").alias("reason"))
    return rows.unionByName(grams)


def accept(results: DataFrame) -> DataFrame:
    """Rows (conversation_id, status, fails, warns): any failure rejects."""
    fails = F.count_if(F.col("verdict") == "fail")
    return results.groupBy("conversation_id").agg(F.when(fails > 0, "rejected").otherwise("accepted").alias("status"), fails.alias("fails"), F.count_if(F.col("verdict") == "warn").alias("warns"))


def validator_rollup(results: DataFrame) -> DataFrame:
    """Per validator: results, the shares of each verdict, and the mean of scores that exist."""
    share = lambda v: F.avg((F.col("verdict") == v).cast("double")).alias(f"{v}_rate")
    return results.groupBy("validator").agg(F.count("*").alias("total"), share("pass"), share("warn"), share("fail"), F.avg("score").alias("mean_score"))


def resolve_formality(run: Column, persona: Column, profile: Column) -> Column:
    """The register by precedence: the run's, unless it inherits; the persona's; the profile's."""
    by_persona = F.when(persona == "baku", "formal").when(persona.isin("colloquial", "manglish"), "colloquial")
    return F.when(run.isNotNull() & (run != "inherit"), run).otherwise(F.coalesce(by_persona, profile))


def drop_repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keeps the first row of each key in order; rows without a key all stay."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.where(F.col(key).isNotNull()).withColumn("__place", place).where("__place = 1").drop("__place").unionByName(rows.where(F.col(key).isNull()))

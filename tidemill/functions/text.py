"""Scalar text functions and predicates, as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, keyword lists and limits of the rules ---
MIN_CHARS = 15
BROKEN_UNICODE = "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
HTML_RESIDUE = r"<[a-zA-Z/][^>]{0,80}>|&[a-z]+;|\{\{.*?\}\}"
PROMPT_WRAPPER = r"(?im)^\s*(system\s*:|###\s*instruction|<\|.*?\|>|assistant\s*:|user\s*:)"
ALLOWED = r"[가-힣a-zA-Z0-9\s.,%()\-/·α-ω]"
JUNK_RATIO = 0.3
REVIEW = r"(용량|처방|투여|수술\s*적응|응급|긴급|확진|진단\s*기준|가이드라인|금기|부작용)"
REFUSALS = ("인공지능인 저는", "AI인 저는", "저는 신체 감각이나 감정을", "감정을 경험할 수 없")
RESTATEMENT = r"\n\s*정답은[:：]?\s"
LEAKAGE = 0.85
MEANINGFUL = "[가-힣a-zA-Z0-9]"
SENTENCE_END = r"(?<=[.!?。！？])\s+"
HARD_BOUNDARY = r"\n\s*\n+|(?=\n\s*제\s*\d+\s*조)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(01[016789]|02|0[3-6][1-4])[-. ]?\d{3,4}[-. ]?\d{4}"
EMAIL_MARK, PHONE_MARK = "[이메일]", "[전화번호]"
ZERO_WIDTH = "[​‌‍﻿]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
REASONING_BLOCK = r"(?is)<think>.*?</think>|<analysis>.*?</analysis>"
REASONING_PREFIX = r"(?im)^(reasoning|chain of thought|step\s*\d+)\s*[:：]\s*"
FINAL_ENDINGS = (".", "!", "?", ")", "다", "요", "죠", "까", "음", "함", "됨")
EMERGENCY = (
    "숨쉬기 힘들", "숨차", "호흡곤란", "숨이 안 쉬어", "숨을 못 쉬", "가슴 통증", "가슴이 아파", "흉통", "가슴 쥐어짜", "가슴 조이", "가슴 답답",
    "의식", "쓰러", "실신", "심한 출혈", "피를 토", "각혈", "경련", "발작", "마비", "말이 어눌",
)
KEYWORD_GAP = 15
DOSAGE = (r"\d+\s?mg", r"(?i)\d+\s?ml", r"\d+\s?정(?!도|확|말|보|신|리|지|상)")
NON_ANSWERS = ("새로운 프롬프트와 함께 다시 시작", "그냥 넘어갈게요")
REVIEW_CATEGORIES = {
    "응급/긴급": "(응급|긴급)", "처방/투여": "(처방|투여)", "용량": "용량", "수술 적응": r"수술\s*적응", "확진/진단기준": r"(확진|진단\s*기준)", "가이드라인": "가이드라인", "금기": "금기", "부작용": "부작용",
}
ANSWER_TOKEN = "[가-힣]+|[a-z0-9]+"
EXTRA_CHARS = {"ko": "가-힣", "ja": "ぁ-んァ-ンー一-鿿", "zh": "一-鿿", "en": ""}
BASE_CHARS = "a-zA-Zα-ωΑ-Ω0-9\\s.,!?:;()\\-/%·\"'~…∼℃±×÷"
# --- end of fixed values ---

#: `(?U)`: white space and word characters by Unicode, as the rules were written for.
UNICODE = "(?U)"


#: White space by Unicode, and with the four information separators: what is stripped from the ends of a text.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = WHITE + "".join(map(chr, range(28, 32)))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends; a native trim, as a pattern would be tried at every character."""
    return F.trim(c, F.lit(SPACES))


def outside(c: Column, allowed: str) -> Column:
    """How many characters are outside a class such as [a-z]; runs are removed at once, and most texts have none."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{UNICODE}[^{allowed[1:-1]}]+", ""))


def normalize_ws(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), UNICODE + r"\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def too_short(c: Column, least: int = MIN_CHARS) -> Column:
    return F.length(strip(c)) < least


def broken_unicode(c: Column) -> Column:
    return c.rlike(BROKEN_UNICODE)


def html_residue(c: Column) -> Column:
    return c.rlike(HTML_RESIDUE)


def prompt_wrapper(c: Column) -> Column:
    return c.rlike(PROMPT_WRAPPER)


def junk_ratio(c: Column, allowed: str = ALLOWED) -> Column:
    """Share of characters outside `allowed` after stripping; 1 for nothing."""
    s = strip(c)
    return F.when(F.length(s) == 0, F.lit(1.0)).otherwise(outside(s, allowed) / F.length(s))


def reject_reason(c: Column, least: int = MIN_CHARS, allowed: str = ALLOWED, ratio: float = JUNK_RATIO) -> Column:
    """The first gate a text fails, or null where it passes."""
    s = strip(c)
    return (
        F.when(c.isNull() | too_short(s, least), "too_short").when(broken_unicode(s), "broken_unicode").when(html_residue(s), "html_residue")
        .when(prompt_wrapper(s), "prompt_wrapper").when(junk_ratio(s, allowed) > ratio, "junk_ratio")
    )


def clean_content(c: Column, **limits) -> Column:
    """The stripped text where every gate passes, else null; characters are never changed."""
    return F.when(reject_reason(c, **limits).isNull(), strip(c))


def contains_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts], F.lit(False))


def needs_review(c: Column, pattern: str = REVIEW) -> Column:
    return c.rlike(UNICODE + pattern)


def garbage(c: Column, least: int = 2) -> Column:
    return ~c.rlike("(?s)" + ".*?".join([MEANINGFUL] * least))


def keyword_pattern(keywords=EMERGENCY, gap: int = KEYWORD_GAP) -> str:
    """One alternation; the words of a keyword may be `gap` characters apart, on one line."""
    import re

    return "|".join(f".{{0,{gap}}}".join(re.escape(p) for p in k.split(" ")) for k in keywords)


def emergency(c: Column, keywords=EMERGENCY, gap: int = KEYWORD_GAP) -> Column:
    return c.rlike(keyword_pattern(keywords, gap))


def risky_dosage(c: Column, patterns=DOSAGE) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(UNICODE + p) for p in patterns])


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, UNICODE + SENTENCE_END), strip), lambda x: x != "")


def hard_blocks(c: Column, boundary: str = UNICODE + HARD_BOUNDARY) -> Column:
    return F.filter(F.split(c, boundary), lambda x: strip(x) != "")


def count_tokens(c: Column) -> Column:
    """The native counter: runs of word characters, and every other visible character."""
    return F.regexp_count(c, F.lit(UNICODE + r"\w+|[^\w\s]"))


def strip_restatement(c: Column) -> Column:
    """Without the tail that restates the answer; the text itself where nothing would be left."""
    at = F.regexp_instr(c, F.lit(UNICODE + RESTATEMENT))
    return F.when(at > 0, F.coalesce(F.nullif(strip(F.substring(c, F.lit(1), at - 1)), F.lit("")), c)).otherwise(c)


def mask_pii(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, EMAIL_MARK), PHONE, PHONE_MARK)


def count_pii(c: Column) -> Column:
    return F.regexp_count(c, F.lit(EMAIL)) + F.regexp_count(F.regexp_replace(c, EMAIL, EMAIL_MARK), F.lit(PHONE))


def clean_text(c: Column, nfc=None) -> Column:
    """Composed form (nfc: a UDF of tidemill.functions.udfs, where texts aren't known to be composed), no invisible characters, single spaces."""
    t = F.coalesce(c, F.lit(""))
    t = nfc(t) if nfc else t
    return normalize_ws(F.regexp_replace(F.regexp_replace(t, ZERO_WIDTH, ""), CONTROL, ""))


def clean_document_text(c: Column, nfkc=None, collapse_blanks: bool = False) -> Column:
    """Line ends, control characters, trailing blanks and long gaps put right; lines stay lines."""
    t = nfkc(c) if nfkc else c
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    if collapse_blanks:
        t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def strip_reasoning(c: Column) -> Column:
    return normalize_ws(F.regexp_replace(F.regexp_replace(c, REASONING_BLOCK, ""), REASONING_PREFIX, ""))


def normalize_answer(c: Column, nfkc=None) -> Column:
    t = F.coalesce(c, F.lit(""))
    return normalize_ws(F.lower(nfkc(t) if nfkc else t))


def exact_match(a: Column, b: Column, nfkc=None) -> Column:
    return (normalize_answer(a, nfkc) == normalize_answer(b, nfkc)).cast("double")


def token_f1(expected: Column, predicted: Column, nfkc=None) -> Column:
    """F1 of token multisets; 1 where both are empty, 0 where one is."""
    a, b = (F.regexp_extract_all(normalize_answer(c, nfkc), F.lit(ANSWER_TOKEN), F.lit(0)) for c in (expected, predicted))
    both = F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def recall_at(rank: Column, k: int) -> Column:
    return F.when((rank <= k) & F.lit(k > 0), 1.0).otherwise(0.0)


def precision_at(rank: Column, k: int) -> Column:
    return F.when((rank <= k) & F.lit(k > 0), 1.0 / max(k, 1)).otherwise(0.0)


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when((rank <= k) & F.lit(k > 0), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def input_language(c: Column) -> Column:
    return F.when(c.rlike("[가-힣]"), "ko").when(c.rlike("[ぁ-んァ-ンー]"), "ja").when(c.rlike("[一-鿿]"), "zh").when(c.rlike("[a-zA-Z]"), "en").otherwise("ko")


def foreign_ratio(c: Column, language: str = "ko") -> Column:
    s = strip(c)
    return F.when(F.length(s) == 0, 0.0).otherwise(outside(s, f"[{BASE_CHARS}{EXTRA_CHARS.get(language, EXTRA_CHARS['ko'])}]") / F.length(s))


def pad_vector(v: Column, width: int) -> Column:
    """Zeros up to `width`; longer vectors are an error."""
    return F.when(F.size(v) > width, F.raise_error(F.lit("vector is wider than the store")).cast("array<float>")).otherwise(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(v))))


def narrow_vector(v: Column, width: int) -> Column:
    return F.slice(v, 1, width)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def ends_with_any(c: Column, endings) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(e) for e in endings])


def quality_verdict(user: Column, assistant: Column, least: int = 5, most_user: int = 2000, most_assistant: int = 4000) -> Column:
    """Why a question-answer pair is turned down, or null."""
    u, a = F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit(""))
    left = F.length(F.regexp_replace(a, r"(.)\1{9,}", ""))
    return (
        F.when((u == "") | (a == ""), "empty").when(u == a, "invalid_answer").when((F.length(u) < least) | (F.length(a) < least), "too_short")
        .when((F.length(u) > most_user) | (F.length(a) > most_assistant), "too_long").when(left < F.length(a) * 0.3, "low_quality")
    )


def embedding_problem(v: Column, dimension: int) -> Column:
    """Why a vector can't be stored, or null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(~finite, "not_finite")


def canonical_url(c: Column) -> Column:
    """http(s) URLs with a lower-case host, no default port, a path and no fragment; null for what isn't one."""
    parts = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#.*)?$"
    scheme, host = F.lower(F.regexp_extract(c, parts, 1)), F.lower(F.regexp_extract(c, parts, 2))
    path, query = F.regexp_extract(c, parts, 3), F.regexp_extract(c, parts, 4)
    port = F.regexp_extract(host, r":(\d*)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    ok = (F.length(c) <= 500) & (scheme != "") & ~host.contains("@") & default
    return F.when(ok, F.concat(scheme, F.lit("://"), F.regexp_replace(host, r":\d*$", ""), F.when(path == "", "/").otherwise(path), query))


def document_key(source: Column, original_id: Column) -> Column:
    return F.concat(F.lit("hf-dataset://"), source, F.lit("/"), original_id)


def file_reference(prefix: str, name: Column) -> Column:
    quoted = F.regexp_replace(F.url_encode(name), r"\+", "%20")
    full = F.concat(F.lit(prefix), quoted)
    return F.when(F.length(full) > 500, F.concat(F.lit(prefix), F.sha2(name, 256))).otherwise(full)

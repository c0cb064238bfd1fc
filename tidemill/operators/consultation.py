"""Consultation rules: departments, outcomes, prompts, and the sanitiser of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.sources.adapters import DEPARTMENTS, single_department

# --- fixed values ---
DEPARTMENT_KEYWORDS = {
    "내과": ("복통", "배가 아", "속이 아", "설사", "변비", "소화", "메스꺼", "구토", "발열", "열이", "기침", "가래", "속쓰림", "위염", "위산", "당뇨", "고혈압"),
    "순환기내과": ("두근거림", "두근두근", "심장이 뛰", "심장 두근", "가슴 두근", "부정맥", "가슴이 뻐근", "가슴 답답", "흉통", "가슴 통증", "가슴이 아"),
    "이비인후과": ("목이 아", "인후통", "콧물", "코막힘", "코피", "중이염", "귀가 아", "귀 통증", "어지럼", "어지러", "이명", "목소리", "쉰 목소리", "편도"),
    "피부과": ("발진", "두드러기", "가려움", "가렵", "피부", "여드름", "습진", "아토피", "물집", "붉은 반점", "탈모"),
    "정형외과": ("허리", "무릎", "관절", "골절", "삐끗", "어깨", "고개", "근육통", "디스크", "손목", "발목", "결림", "결려", "뻐근"),
    "신경과": ("두통", "머리가 아", "저림", "마비", "떨림", "경련", "어지러움", "시야", "언어장애", "기억력"),
    "안과": ("눈이 아", "시력", "눈 충혈", "눈물", "안구건조", "눈이 침침", "안압", "눈 통증", "눈에 통증", "눈이 피로", "눈 피로", "눈이 뻑뻑"),
    "산부인과": ("생리", "월경", "임신", "질염", "하복부 통증(여성)"),
    "비뇨의학과": ("배뇨", "소변", "혈뇨", "전립선", "요로감염"),
    "정신건강의학과": ("불안", "우울", "불면", "잠이 안", "공황", "스트레스"),
    "소아청소년과": ("아기가", "영유아", "신생아", "소아"),
}
BLOCK_HEADER = "[참고 의료 정보]"
HIGH, MIDDLE, LOW = "높음", "중간", "낮음"
SPECIAL_TOKEN = "</?s>"
MARKDOWN = ((r"(?m)^\s*```\w*\s*$", ""), (r"`([^`\n]+?)`", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*([^\*\n]+?)\*(?!\*)", "$1"), (r"(?m)^[ \t]*[*\-•][ \t]+", ""), (r"(?m)^[ \t]*#{1,6}[ \t]*", ""))
DISCLAIMERS = ("면책 조항", "면책조항", "disclaimer", "의료 전문가가 아니", "전문가가 아니므로", "전문적인 의학적 조언을 대체", "의학적 조언으로 간주", "의학적 조언으로 해석")
LABEL_LINE = r"^(?:라벨|모델|Label|Model|DisplayName)\s*[:：]?\s*.{0,60}$"
ROLE_LINE = r"(?i)^(?:user|assistant|system|model|환자|의사|사용자|AI)\s*[:：]\s*.*$"
LEAK_MARKERS = ("DisplayName", "Example Response")
LABEL_PHRASES = ("Display comment ", "DisplayName ", "Example Response ")
INLINE_REPEAT = r"(.{2,30}?)\1{2,}\s*$"
HINT_LABEL = r"[({]\s*참고용\s*진료과\s*정보\s*[)}]\s*"
LAST_PARENTHESIS = r"[({]([^(){}]*)[)}]\s*$"
ENDINGS = (".", "!", "?", ")", "다", "요", "죠", "까")
FOREIGN_SHARE, ANCHOR_CHARS, ORPHAN_CHARS = 0.3, 20, 15
DOSAGE_WARNING = "\n\n[안전 안내] 구체적인 약물 용량/처방은 반드시 의사·약사와 상담 후 결정하세요."
# --- end of fixed values ---


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, X.UNICODE + r"\s+", "")


def classified(df: DataFrame, text: str = "text", lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with department, confidence and matched_keywords by keyword hits; spaces don't count. The first of equal departments wins at
    a middle confidence. The lexicon becomes expressions of the plan: no join, no shuffle."""
    lexicon = lexicon or DEPARTMENT_KEYWORDS
    bare = df.withColumn("_bare", _squeezed(F.coalesce(text, F.lit(""))))
    hits = [F.struct(F.lit(d).alias("department"), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("_bare", _squeezed(w))).alias("words"), F.lit(-i).alias("place")) for i, (d, words) in enumerate(lexicon.items())]
    scored = bare.withColumn("_hits", F.filter(F.array(*hits), lambda h: F.size(h["words"]) > 0))
    ranked = scored.withColumn("_hits", F.reverse(F.array_sort(F.transform("_hits", lambda h: F.struct(F.size(h["words"]).alias("n"), h["place"].alias("place"), h["department"].alias("department"), h["words"].alias("words"))))))
    first, second = F.get("_hits", F.lit(0)), F.get("_hits", F.lit(1))
    tied = F.coalesce(second["n"] == first["n"], F.lit(False))
    confidence = F.when(first.isNull(), LOW).when(tied, MIDDLE).when(first["n"] >= 2, HIGH).otherwise(MIDDLE)
    return ranked.withColumns({"department": first["department"], "confidence": confidence, "matched_keywords": F.coalesce(first["words"], F.array().cast("array<string>"))}).drop("_bare", "_hits")


def resolved(given: Column, given_confidence: Column, voted: Column, classified: Column) -> Column:
    """A sure given department, else the results' vote, else the given one, else the classifier's."""
    return F.coalesce(F.when(given_confidence == HIGH, given), voted, given, classified)


def filled_from_answer(department: Column, confidence: Column, answer: Column, names=DEPARTMENTS) -> tuple[Column, Column]:
    said = single_department(answer, names)
    return F.coalesce(department, said), F.when(department.isNull() & said.isNotNull(), MIDDLE).otherwise(confidence)


def outcomes(df: DataFrame, question: str, answer: str, chunks: str, emergency: Column | None = None) -> DataFrame:
    """df with is_emergency, is_fallback, error_type, rag_hit_count: an emergency never reaches the model; an empty answer falls back."""
    danger = X.emergency(F.col(question)) if emergency is None else emergency
    empty = X.strip(F.coalesce(answer, F.lit(""))) == ""
    return df.withColumns({
        "is_emergency": danger, "is_fallback": ~danger & empty, "error_type": F.when(~danger & empty, "NonAnswerFiltered"), "rag_hit_count": F.when(danger, 0).otherwise(F.size(chunks)),
    })


def prompt(system: str, history: Column, question: Column, hint: Column | None = None, block: Column | None = None) -> Column:
    """array<struct<role,content>>: system, history (array of question and answer), then hint, references and question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    told = F.flatten(F.transform(history, lambda h: F.array(message("user", h["question"]), message("assistant", h["answer"]))))
    asked = F.concat_ws("\n\n", *[c for c in (hint, block) if c is not None], question)
    return F.concat(F.array(message("system", F.lit(system))), told, F.array(message("user", asked)))


# --- the sanitiser: one expression a rule, applied in order ---


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a lambda's variable stands for it, so that chained rules don't multiply the plan."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, X.UNICODE + r"\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _drop_last_lines(c: Column, unwanted: Callable[[Column], Column]) -> Column:
    """Without the longest run of last lines that are blank or unwanted."""
    lines = _lines(c)
    bad = F.transform(lines, lambda x: (X.strip(x) == "") | unwanted(X.strip(x)))
    last = F.aggregate(F.sequence(F.lit(1), F.size(bad)), F.lit(0), lambda a, i: F.when(F.element_at(bad, i), a).otherwise(i))
    return _rstrip(F.array_join(F.slice(lines, F.lit(1), last), "\n"))


def special_tokens(c: Column) -> Column:
    return F.regexp_replace(c, SPECIAL_TOKEN, "")


def prompt_echo(fragments=LEAK_MARKERS) -> Callable[[Column], Column]:
    def rule(c: Column) -> Column:
        at = F.least(*[F.nullif(F.locate(f, c), F.lit(0)) for f in fragments], F.lit(None).cast("int")) if len(fragments) > 1 else F.nullif(F.locate(fragments[0], c), F.lit(0))
        return F.when(at.isNotNull(), _rstrip(F.substring(c, F.lit(1), at - 1))).otherwise(c)

    return rule


def repeated_opening(c: Column) -> Column:
    """Up to the first line with words, where a later line opens as it does."""
    lines = _lines(c)
    at = F.array_position(F.transform(lines, lambda x: X.strip(x) != ""), True)
    opening = X.strip(F.try_element_at(lines, F.nullif(at, F.lit(0)).cast("int")))
    again = F.exists(F.slice(lines, (at + 1).cast("int"), F.size(lines)), lambda x: F.substring(X.strip(x), 1, ANCHOR_CHARS) == F.substring(opening, 1, ANCHOR_CHARS))
    return F.when((at > 0) & (F.length(opening) >= ANCHOR_CHARS) & again, _rstrip(F.array_join(F.slice(lines, F.lit(1), at.cast("int")), "\n"))).otherwise(c)


def label_phrases(c: Column) -> Column:
    for p in LABEL_PHRASES:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def open_fence(c: Column) -> Column:
    """Up to the line of the last code fence where their number is odd."""
    odd = F.regexp_count(c, F.lit("```")) % 2 == 1
    return F.when(odd, _rstrip(F.regexp_replace(c, r"(?s)[^\n]*```(?!.*```).*$", ""))).otherwise(c)


def markdown(c: Column) -> Column:
    for pattern, by in MARKDOWN:
        c = F.regexp_replace(c, X.UNICODE + pattern, by)
    return c


def own_disclaimer(c: Column) -> Column:
    parts = F.split(c, "\n\n")
    last = F.lower(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & (X.strip(last) != "") & X.contains_any(last, DISCLAIMERS), _rstrip(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\n\n"))).otherwise(c)


def repeated_lines(c: Column, most_lines: int = 4, least_times: int = 3) -> Column:
    """Without units of one to `most_lines` lines that stand `least_times` times or more at the end; blank lines don't count.

    A unit of u lines repeats as often as lines equal those u further on, counted from the end, say.
    """
    lines = _lines(c)
    told = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lower(X.strip(x)).alias("x"))), lambda s: s["x"] != "")

    def equal(full: Column, u: int) -> Column:
        """How many lines in a row, from the last that has a line u further on, equal that line."""

        def grow(a: Column, k: Column) -> Column:
            same = F.try_element_at(full, F.size(full) - k - u + 1)["x"] == F.try_element_at(full, F.size(full) - k + 1)["x"]
            return F.when(a["on"] & same, F.struct(F.lit(True).alias("on"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), a["n"].alias("n")))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(full) - u, F.lit(1))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), grow, lambda a: a["n"])

    def cut(full: Column) -> Column:
        places = []
        for u in range(1, most_lines + 1):
            times = F.floor(equal(full, u) / u).cast("int") + 1
            places.append(F.when((F.size(full) > u) & (times >= least_times), F.try_element_at(full, F.size(full) - times * u + 1)["i"]))
        return F.least(*places)

    return _let(_let(told, cut), lambda at: F.when(at.isNotNull(), _rstrip(F.array_join(F.slice(lines, F.lit(1), at), "\n"))).otherwise(c))


def inline_repetition(c: Column) -> Column:
    return F.when(c.rlike(INLINE_REPEAT), _rstrip(F.regexp_replace(c, INLINE_REPEAT, ""))).otherwise(c)


def json_tail(c: Column) -> Column:
    """Without a JSON object that opens at the last brace and ends the text."""
    at = F.length(c) - F.length(F.substring_index(c, "{", -1))
    tail = X.strip(F.substring(c, at, F.length(c)))
    whole = c.contains("{") & tail.endswith("}") & F.try_parse_json(tail).isNotNull()
    return F.when(whole, _rstrip(F.substring(c, F.lit(1), at - 1))).otherwise(c)


def label_lines(c: Column) -> Column:
    return _drop_last_lines(c, lambda x: x.rlike(LABEL_LINE))


def role_lines(c: Column) -> Column:
    return _drop_last_lines(c, lambda x: x.rlike(ROLE_LINE))


def foreign_lines(language: str = "ko") -> Callable[[Column], Column]:
    return lambda c: _drop_last_lines(c, lambda x: X.foreign_ratio(x, language) >= FOREIGN_SHARE)


def orphan_tail(c: Column) -> Column:
    lines = _lines(c)
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), X.strip(x).alias("x"))), lambda s: s["x"] != "")
    last, before = F.try_element_at(full, F.lit(-1)), F.try_element_at(full, F.lit(-2))
    orphan = (F.size(full) >= 2) & (F.length(last["x"]) <= ORPHAN_CHARS) & ~X.ends_with_any(last["x"], ENDINGS) & X.ends_with_any(before["x"], ENDINGS[:4])
    return F.when(orphan, _rstrip(F.array_join(F.slice(lines, F.lit(1), last["i"]), "\n"))).otherwise(c)


def hint_label(c: Column) -> Column:
    return F.regexp_replace(c, X.UNICODE + HINT_LABEL, "")


def department_parenthesis(c: Column) -> Column:
    inner = X.strip(F.regexp_extract(c, LAST_PARENTHESIS, 1))
    before = _rstrip(F.regexp_replace(_rstrip(c), LAST_PARENTHESIS, ""))
    return F.when(c.rlike(LAST_PARENTHESIS) & X.contains_any(inner, DEPARTMENTS), F.when(before == "", inner).otherwise(F.concat(before, F.lit(" "), inner))).otherwise(c)


def final_check(c: Column) -> Column:
    return F.when(X.contains_any(c, X.NON_ANSWERS), "").when(X.risky_dosage(c), F.concat(c, F.lit(DOSAGE_WARNING))).otherwise(c)


def rules(fragments=LEAK_MARKERS, language: str = "ko") -> list[tuple[str, Callable[[Column], Column]]]:
    return [
        ("special_tokens", special_tokens), ("prompt_echo", prompt_echo(fragments)), ("repeated_opening", repeated_opening), ("label_phrases", label_phrases), ("open_fence", open_fence), ("markdown", markdown),
        ("own_disclaimer", own_disclaimer), ("repeated_lines", repeated_lines), ("inline_repetition", inline_repetition), ("json_tail", json_tail), ("label_lines", label_lines), ("role_lines", role_lines),
        ("foreign_lines", foreign_lines(language)), ("orphan_tail", orphan_tail), ("hint_label", hint_label), ("department_parenthesis", department_parenthesis), ("final_check", final_check),
    ]


def _applied(state: Column, name: str, rule: Callable[[Column], Column]) -> Column:
    def changed(old: Column, new: Column) -> Column:
        return F.struct(new.alias("text"), F.when(new != old["text"], F.array_append(old["rules"], F.lit(name))).otherwise(old["rules"]).alias("rules"))

    return _let(state, lambda old: _let(rule(old["text"]), lambda new: changed(old, new)))


def sanitize(df: DataFrame, answer: str = "answer", **options) -> DataFrame:
    """df with `sanitized` and `rules`, the names of the rules that changed the answer, in order. Native throughout. Null stays null."""
    state = F.struct(F.col(answer).alias("text"), F.array().cast("array<string>").alias("rules"))
    for name, rule in rules(**options):
        state = _applied(state, name, rule)
    return df.withColumn("_after", state).withColumns({"sanitized": F.col("_after.text"), "rules": F.col("_after.rules")}).drop("_after")


def rule_report(sanitized: DataFrame) -> DataFrame:
    return sanitized.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def reference_block(chunks: DataFrame, by: str, order: str, most: int = 5, most_chars: int = 800, text: str = "chunk", origin: str = "origin", tier: str = "tier", departments: str = "departments", header: str = BLOCK_HEADER) -> DataFrame:
    """(by, block): the first `most` chunks with a text of each group, told apart by number, origin, tier and departments, where they have
    them. A text beyond most_chars is cut and marked; a group without a text has no block. Only the first chunks of a group are shuffled."""
    own = chunks.select(by, order, X.strip(F.col(text)).alias("_t"), F.col(origin).alias("_o"), F.col(tier).alias("_tier"), F.col(departments).alias("_d")).where("_t <> ''")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    said = F.when(F.length("_t") > most_chars, F.concat(F.regexp_replace(F.substring("_t", 1, most_chars), r"\s+$", ""), F.lit("…"))).otherwise(F.col("_t"))
    source = F.when(X.strip(F.coalesce("_o", F.lit(""))) != "", F.concat(F.lit("\n출처: "), X.strip(F.col("_o")), F.coalesce(F.concat(F.lit(" (신뢰도: "), "_tier", F.lit(")")), F.lit("")))).otherwise("")
    named = F.when(F.size("_d") > 0, F.concat(F.lit("\n관련 진료과: "), F.array_join("_d", ", "))).otherwise("")
    line = F.concat(F.lit("\n\n[문서 "), F.col("_n"), F.lit("]"), source, named, F.lit("\n"), said)
    return first.groupBy(by).agg(F.concat(F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "")).alias("block"))

from pyspark.sql import functions as F

from tidemill.operators import consultation as C
from tidemill.sources.adapters import single_department


def sanitized(spark, text, **options):
    return C.sanitize(spark.createDataFrame([(text,)], "answer string"), **options).first()


CASES = [
    ("안녕하세요 좋은 답변입니다.</s></s>", "안녕하세요 좋은 답변입니다.", "special_tokens"),
    ("좋은 답변입니다. DisplayName: 무엇", "좋은 답변입니다.", "prompt_echo"),
    ("이것은 스무 글자가 넘는 아주 긴 첫 번째 줄입니다.\n쓰레기\n이것은 스무 글자가 넘는 아주 긴 첫 번째", "이것은 스무 글자가 넘는 아주 긴 첫 번째 줄입니다.", "repeated_opening"),
    ("정상 답변입니다.\n라벨```json\n{\"응답\": \"충", "정상 답변입니다.", "open_fence"),
    ("**굵게** 말합니다.", "굵게 말합니다.", "markdown"),
    ("쉬세요.\n\n면책 조항: 저는 의사가 아닙니다.", "쉬세요.", "own_disclaimer"),
    ("정상입니다.\n[]\n[]\n[]", "정상입니다.", "repeated_lines"),
    ("정상입니다. 라벨_end{라벨_end{라벨_end{", "정상입니다.", "inline_repetition"),
    ("정상입니다.\n{\"a\": 1}", "정상입니다.", "json_tail"),
    ("정상입니다.\n모델", "정상입니다.", "label_lines"),
    ("정상입니다.\n환자: 네?", "정상입니다.", "role_lines"),
    ("정상입니다.\nЕщё неясно. Можете помочь", "정상입니다.", "foreign_lines"),
    ("고려해볼 수 있습니다.\n Hakim", "고려해볼 수 있습니다.", "orphan_tail"),
    ("{참고용 진료과 정보} 정형외과에서 진료를 받으세요.", "정형외과에서 진료를 받으세요.", "hint_label"),
    ("쉬세요. (정형외과에서 진료를 받아보세요.)", "쉬세요. 정형외과에서 진료를 받아보세요.", "department_parenthesis"),
    ("그냥 넘어갈게요.", "", "final_check"),
    ("하루 500mg 드세요.", "하루 500mg 드세요." + C.DOSAGE_WARNING, "final_check"),
]


def test_each_rule(spark):
    df = C.sanitize(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, answer string"))
    for r in df.collect():
        assert (r.sanitized, CASES[r.i][2] in r.rules) == (CASES[r.i][1], True), (CASES[r.i], r)


def test_sound_answers_stay(spark):
    for text in ("의사소통이 중요합니다.", "고열(38도 이상)이면 병원에 가세요.", "MRI 검사를 받아보세요.", "감사합니다.\n도움이 되었나요?", "2정도 쉬세요."):
        row = sanitized(spark, text)
        assert row.sanitized == text and row.rules == []
    assert sanitized(spark, None).sanitized is None


def test_classifier(spark):
    texts = ["", "배가아파서 설사를 해요", "무릎이 아파요", "눈이 아프고 허리가 결려요", "안녕"]
    rows = C.classified(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [(r.department, r.confidence) for r in rows] == [(None, "낮음"), ("내과", "높음"), ("정형외과", "중간"), ("정형외과", "높음"), (None, "낮음")]


def test_single_department(spark):
    texts = ["순환기내과로 가세요", "내과와 안과", "없음", "내과 내과"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(single_department(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["순환기내과", None, None, "내과"]

"""Human-readable labels, kept apart from the facts and joined on at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail.operators.hosts import small_table

FALLBACK_LOCALE = "ko"

# Fixed values: (path, English, Korean).
LABELS = [
    ("level.high", "High", "높음"),
    ("level.medium", "Caution", "주의"),
    ("level.low", "Low", "낮음"),
    ("level.unknown", "Unknown", "판단 불가"),
    ("data.identity", "Identity", "신원 정보"),
    ("data.contact", "Contact", "연락처"),
    ("data.account", "Account Info", "계정 정보"),
    ("data.payment", "Payment Information", "결제 정보"),
    ("data.device", "Device/Access Info", "기기 및 접속 정보"),
    ("data.location", "Location", "위치 정보"),
    ("data.usage", "Usage Behavior", "이용 행태"),
    ("data.biometric", "Sensitive/Biometric", "민감/생체 정보"),
    ("positive.delete_right", "Deletion/withdrawal rights", "삭제/탈퇴 권리 안내"),
    ("positive.security_controls", "Security controls mentioned", "보안 조치 언급"),
    ("positive.retention_policy", "Data retention guidance", "데이터 보유 기간 안내"),
    ("risk.broad_data_sharing", "Possible broad third-party disclosure", "광범위한 제3자 제공 가능성"),
    ("risk.behavioral_ads", "Personalized advertising and tracking", "맞춤형 광고 및 추적"),
    ("risk.policy_change", "Wide scope of terms-change notice", "약관 변경 통지 범위가 넓음"),
    ("risk.account_termination", "Account suspension/termination discretion", "계정 제한/해지 재량"),
    ("risk.liability_limit", "Liability limitation clause", "책임 제한 조항"),
    ("risk.retention_unclear", "Retention period may be unclear", "보유 기간이 불명확할 수 있음"),
    ("risk.overseas_transfer", "Possible international transfer", "국외 이전 가능성"),
    ("risk.arbitration", "Potential limitation of dispute rights", "분쟁 해결 권리 제한 가능성"),
    ("risk.security_vague", "Security controls are described vaguely", "보안 조치 설명이 추상적"),
    ("risk.children", "Clauses for children / minors", "아동/청소년 데이터 관련 조항"),
    ("summary.intro", "Risk level appears to be '$1'.", "위험도는 '$1'으로 보입니다."),
    ("summary.data", "The document suggests possible collection of: $1.", "문서에서 $1 수집 가능성이 확인됩니다."),
    (
        "summary.no_data",
        "No clear personal data category is detected; check a dedicated data collection table in policy text.",
        "명확히 감지된 개인정보 항목은 적지만, 원문에서 수집 항목 표를 직접 확인해야 합니다.",
    ),
    ("summary.risk", "Check '$1' first.", "특히 '$1' 조항을 먼저 확인하세요."),
    ("summary.positive", "Positives found: $1.", "긍정적으로는 $1가 언급됩니다."),
]


def label_table(spark: SparkSession) -> DataFrame:
    """(locale, path, label)."""
    rows = [("en", path, english) for path, english, _ in LABELS] + [("ko", path, korean) for path, _, korean in LABELS]
    return small_table(spark, rows, "locale string, path string, label string")


def with_label(df: DataFrame, labels: DataFrame, path: Column, locale: str, name: str = "label") -> DataFrame:
    """Adds the label of ``path`` in the locale, else in Korean, else the path itself.

    ``labels`` may hold a user's own rows: (locale, path, label).
    """
    wanted = labels.filter(F.col("locale").isin(locale, FALLBACK_LOCALE))
    chosen = wanted.groupBy("path").agg(F.max_by("label", F.col("locale") == locale).alias(name))
    # A user may add rows, so the join is left to the optimizer.
    joined = df.withColumn("_path", path).join(chosen, F.col("_path") == F.col("path"), "left")
    return joined.withColumn(name, F.coalesce(name, "_path")).drop("_path", "path")


def summary(results: DataFrame, locale: str = "en") -> DataFrame:
    """(doc_id, summary): level, data found, the first risk and at most two good signs."""
    texts = {path: (english if locale == "en" else korean) for path, english, korean in LABELS}
    names = F.create_map(*[F.lit(x) for path, text in texts.items() if not path.startswith("summary.") for x in (path, text)])

    def named(kind: str, id: Column) -> Column:
        return F.coalesce(F.element_at(names, F.concat(F.lit(f"{kind}."), id)), id)

    def filled(path: str, value: Column) -> Column:
        return F.replace(F.lit(texts[path]), F.lit("$1"), value)

    data = F.array_join(F.transform("data_categories", lambda c: named("data", c["id"])), ", ")
    good = F.array_join(F.transform(F.slice("positives", 1, 2), lambda p: named("positive", p)), ", ")
    first = F.try_element_at(F.col("risks"), F.lit(1))["id"]
    parts = F.concat_ws(
        " ",
        filled("summary.intro", named("level", F.col("level"))),
        F.when(F.size("data_categories") > 0, filled("summary.data", data)).otherwise(F.lit(texts["summary.no_data"])),
        F.when(first.isNotNull(), filled("summary.risk", named("risk", first))),
        F.when(F.size("positives") > 0, filled("summary.positive", good)),
    )
    return results.select("doc_id", parts.alias("summary"))

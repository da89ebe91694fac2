"""Query text: abbreviations, synonyms, variants and key terms, by the tables below or the caller's.

A dictionary is a list of (term, synonyms) in order, small enough to hold as expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "DM": "diabetes mellitus",
    "HTN": "hypertension",
    "CVD": "cardiovascular disease",
    "CVA": "cerebrovascular accident",
    "MI": "myocardial infarction",
    "CHF": "congestive heart failure",
    "COPD": "chronic obstructive pulmonary disease",
    "CKD": "chronic kidney disease",
    "RA": "rheumatoid arthritis",
    "OA": "osteoarthritis",
    "T2DM": "type 2 diabetes mellitus",
    "T1DM": "type 1 diabetes mellitus",
    "HbA1c": "glycated hemoglobin",
    "BMI": "body mass index",
    "BP": "blood pressure",
    "HR": "heart rate",
    "ECG": "electrocardiogram",
    "EKG": "electrocardiogram",
    "MRI": "magnetic resonance imaging",
    "CT": "computed tomography",
    "PET": "positron emission tomography",
    "ICU": "intensive care unit",
    "ED": "emergency department",
    "GI": "gastrointestinal",
    "CNS": "central nervous system",
    "HIV": "human immunodeficiency virus",
    "AIDS": "acquired immunodeficiency syndrome",
    "COVID": "coronavirus disease",
    "SARS": "severe acute respiratory syndrome",
}
# Terms and their synonyms, in order.
SYNONYMS = (
    ("diabetes", ("diabetes mellitus", "DM", "diabetic", "hyperglycemia", "blood sugar disorder")),
    ("糖尿病", ("diabetes", "diabetes mellitus", "DM", "血糖异常", "高血糖")),
    ("hypertension", ("high blood pressure", "HTN", "elevated blood pressure", "arterial hypertension")),
    ("高血压", ("hypertension", "HTN", "血压升高", "动脉高压")),
    ("cancer", ("carcinoma", "malignancy", "tumor", "neoplasm", "oncology")),
    ("癌症", ("cancer", "carcinoma", "malignancy", "肿瘤", "恶性肿瘤")),
    ("heart disease", ("cardiovascular disease", "CVD", "cardiac disease", "heart condition")),
    ("心脏病", ("heart disease", "cardiovascular disease", "CVD", "心血管疾病")),
    ("stroke", ("cerebrovascular accident", "CVA", "brain attack", "cerebral infarction")),
    ("中风", ("stroke", "CVA", "脑卒中", "脑梗塞", "脑血管意外")),
    ("alzheimer", ("alzheimer's disease", "AD", "dementia", "cognitive decline")),
    ("阿尔茨海默", ("alzheimer", "AD", "老年痴呆", "认知障碍")),
    ("asthma", ("bronchial asthma", "reactive airway disease", "wheezing disorder")),
    ("哮喘", ("asthma", "bronchial asthma", "支气管哮喘")),
    ("arthritis", ("joint inflammation", "rheumatoid arthritis", "osteoarthritis", "RA", "OA")),
    ("关节炎", ("arthritis", "RA", "OA", "风湿性关节炎", "骨关节炎")),
    ("pneumonia", ("lung infection", "pulmonary infection", "chest infection")),
    ("肺炎", ("pneumonia", "lung infection", "肺部感染")),
    ("obesity", ("overweight", "adiposity", "excess weight", "BMI elevation")),
    ("肥胖", ("obesity", "overweight", "超重", "体重过重")),
    ("fever", ("pyrexia", "elevated temperature", "febrile", "hyperthermia")),
    ("发烧", ("fever", "pyrexia", "发热", "体温升高")),
    ("pain", ("ache", "discomfort", "soreness", "tenderness", "algesia")),
    ("疼痛", ("pain", "ache", "不适", "酸痛")),
    ("fatigue", ("tiredness", "exhaustion", "weakness", "lethargy", "asthenia")),
    ("疲劳", ("fatigue", "tiredness", "乏力", "虚弱")),
    ("cough", ("tussis", "coughing", "expectoration")),
    ("咳嗽", ("cough", "tussis", "干咳", "咳痰")),
    ("headache", ("cephalalgia", "head pain", "migraine")),
    ("头痛", ("headache", "cephalalgia", "偏头痛")),
    ("treatment", ("therapy", "management", "intervention", "cure", "remedy")),
    ("治疗", ("treatment", "therapy", "management", "疗法", "干预")),
    ("surgery", ("operation", "surgical procedure", "surgical intervention")),
    ("手术", ("surgery", "operation", "外科手术")),
    ("medication", ("drug", "medicine", "pharmaceutical", "pharmacotherapy")),
    ("药物", ("medication", "drug", "medicine", "用药")),
    ("prevention", ("prophylaxis", "preventive measures", "risk reduction")),
    ("预防", ("prevention", "prophylaxis", "预防措施")),
    ("diagnosis", ("diagnostic", "detection", "identification", "assessment")),
    ("诊断", ("diagnosis", "diagnostic", "检测", "评估")),
    ("symptoms", ("signs", "manifestations", "clinical features", "presentations")),
    ("症状", ("symptoms", "signs", "表现", "临床特征")),
)
Dictionary = tuple[tuple[str, tuple[str, ...]], ...]


def expand_abbreviations(query: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Each word that is an abbreviation in any case, but for punctuation at its ends, gives way to its meaning; other words stay. Spaces collapse.

    Keys are compared upper-cased; one that is not upper case never matches.
    """
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    bare = lambda w: F.upper(F.regexp_replace(w, "^[.,?!;:]+|[.,?!;:]+$", ""))
    return F.array_join(F.transform(words(query), lambda w: F.coalesce(F.try_element_at(known, bare(w)), w)), " ")


def synonyms_of(term: Column, table: Dictionary = SYNONYMS) -> Column:
    """Synonyms of a term, or of the term it is a synonym of (the last that lists it)."""
    reverse = {s.lower(): t for t, syns in table for s in (t, *syns)}
    direct = {t.lower(): syns for t, syns in table}
    merged = {k: direct.get(k, direct.get(v.lower(), ())) for k, v in reverse.items()}
    m = F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.try_element_at(m, F.lower(term)), F.array().cast("array<string>"))


def variants(query: Column, n: int = 3, table: Dictionary = SYNONYMS) -> Column:
    """The query, then with the first dictionary term that it holds replaced by each of n synonyms; n + 1 distinct ones at most."""
    out = F.array(query)
    for term, syns in reversed(table):
        swapped = F.array(query, *[F.regexp_replace(query, "(?i)" + _quoted(term), _literal(s)) for s in syns[:n] if s.lower() != term.lower()])
        out = F.when(F.lower(query).contains(term.lower()), swapped).otherwise(out)
    return F.slice(F.array_distinct(out), 1, n + 1)


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in term)


def _literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def enhanced(query: Column, table: Dictionary = SYNONYMS, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """The expanded query, and in brackets up to three synonyms that it lacks: the first two of each term, in dictionary order."""
    low = F.lower(query)
    extra = F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(t.lower()) & ~low.contains(s.lower()), F.lit(s)) for t, syns in table for s in syns[:2]]))), 1, 3)
    base = expand_abbreviations(query, abbreviations)
    return F.when(F.size(extra) > 0, F.concat(base, F.lit(" ("), F.array_join(extra, " "), F.lit(")"))).otherwise(base)


def key_terms(query: Column, table: Dictionary = SYNONYMS) -> Column:
    """Dictionary terms that the query holds, else its words of more than three characters."""
    hits = F.array_compact(F.array(*[F.when(F.lower(query).contains(t.lower()), F.lit(t)) for t, _ in table]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.filter(words(strip(query)), lambda w: F.length(w) > 3))


def merge_variants(df: DataFrame, limit: int) -> DataFrame:
    """(query_id, list_no, pos, text) -> distinct texts per query ignoring case, the first kept, ``limit`` at most, as (query_id, n, text)."""
    seen = Window.partitionBy("query_id", F.lower("text")).orderBy("list_no", "pos")
    first = df.withColumn("_n", F.row_number().over(seen)).filter("_n = 1")
    order = Window.partitionBy("query_id").orderBy("list_no", "pos")
    return first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("query_id", "n", "text")

"""Question classification: intent, content modality, recall depths and fusion weights.

The modality rules are one table, from which both the column expression and the oracle's SQL are
made. ASCII word boundaries are spelled out: Java counts CJK characters as word characters, others
don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config as C
from quarry.functions import text as T

_A, _Z = "(^|[^A-Za-z0-9_])", r"([^A-Za-z0-9_]|\z)"
_PATHY = r"(?i)[/\\]([\w.-]+/)*[\w.-]+\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|go|rs|py|java|kt|swift|rb)" + _Z
# Side, points and pattern of each rule.
RULES = (
    ("nl", 3, r"[?？][\s\x{00A0}\x{3000}\x{FEFF}]*\z"),
    ("nl", 4, r"怎么|如何|为什么|在哪|哪里|哪个|什么|是否|能否|帮我|请问|解释一下|说下|讲讲|(吗|呢)[？?]?\s*\z"),
    ("nl", 3, r"(?i)^(what|how|why|where|when|who|which|is|are|was|were|can|could|would|should|do|does|did|has|have|had|will|shall|may|might|must|please|explain|describe|tell\s+me|walk\s+me|show\s+me|help\s+me)" + _Z),
    ("pl", 4, _A + r"(function|class|interface|type|enum|import|export|async|await|return|const|let|var|extends|implements|namespace|module|package|struct|trait|impl|fn|mut|pub|use|where|def|self)" + _Z),
    ("pl", 2, r"=>|::|->"),
    ("pl", 1, r";\s*\z|;\s*\r?\n"),
    ("pl", 3, r"\)\s*:\s*[\w\[{<]"),
    ("pl", 2, r"Promise\s*<|" + _A + r"Array\s*<"),
    ("pl", 1, r"[{}]\s*;"),
    ("pl", 2, r"\([^)]*\)\s*\{"),
    ("pl", 2, r"<\s*[A-Za-z][\w\s|&,]*>\s*\("),
    ("pl", 5, _PATHY),
    ("pl", 2, r"(?i)" + _A + r"(src|apps|packages|lib|tests?|__tests__)[/\\]"),
    ("pl", 2, _A + r"[A-Za-z_]\w*(\.[A-Za-z_]\w*){2,}" + _Z),
)
_PUNCTUATION = r"[()\[\]{};:,<>=]|=>|::|->"
_BRACKETS = r"[()\[\]{}]"
_IDENTIFIER = r"^[A-Za-z_.][\w.]*\z"
_SEPARATOR, _LETTER, _HUMP, _CAPITALIZED = r"[._]", r"[A-Za-z]", r"[a-z][A-Z]", r"^[A-Z][a-zA-Z0-9]*\z"

#: Least and most results of a question.
TOP_K = (1, 20)


def single_identifier(q: Column) -> Column:
    """One identifier or dotted path of three or more characters."""
    shape = q.rlike(_PATHY) | (q.rlike(_SEPARATOR) & q.rlike(_LETTER)) | q.rlike(_HUMP) | q.rlike(_CAPITALIZED)
    return ~q.rlike(r"\s") & (F.length(q) >= 3) & q.rlike(_IDENTIFIER) & shape


def modality_points(question: Column) -> tuple[Column, Column]:
    """Natural-language and programming-language points."""
    q = F.trim(question)
    solid = F.regexp_replace(q, r"\s", "")
    ratio = F.when(F.length(solid) == 0, 0.0).otherwise(F.regexp_count(solid, F.lit(_PUNCTUATION)) / F.length(solid))
    brackets = F.regexp_count(q, F.lit(_BRACKETS))
    side = {"nl": F.lit(0), "pl": F.lit(0)}
    for where, points, pattern in RULES:
        side[where] = side[where] + F.when(q.rlike(pattern), points).otherwise(0)
    pl = side["pl"] + F.when((brackets >= 4) & (F.length(q) <= 500), F.least(F.lit(4), 1 + F.floor(brackets / 4).cast("int"))).otherwise(0)
    pl = pl + F.when(ratio >= 0.11, 3).otherwise(0) + F.when(single_identifier(q), 3).otherwise(0)
    return side["nl"] + F.when((ratio < 0.04) & (F.length(q) >= 36), 1).otherwise(0), pl


def modality(question: Column, setting: str = "auto") -> Column:
    """``nl`` or ``pl``; a forced setting wins, a tie and a blank question are ``nl``."""
    if setting in ("force_nl", "force_pl"):
        return F.lit(setting[-2:])
    nl, pl = modality_points(question)
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", "nl").when(pl > nl, "pl").otherwise("nl")


def sql_modality(question: str) -> str:
    q = f"trim({question})"
    hits = lambda p: f"regexp_matches({q}, {T.quoted(p)})"
    nl = " + ".join(f"CASE WHEN {hits(p)} THEN {n} ELSE 0 END" for s, n, p in RULES if s == "nl")
    pl = " + ".join(f"CASE WHEN {hits(p)} THEN {n} ELSE 0 END" for s, n, p in RULES if s == "pl")
    solid = rf"regexp_replace({q}, '\s', '', 'g')"
    ratio = f"(CASE WHEN length({solid}) = 0 THEN 0 ELSE len(regexp_extract_all({solid}, {T.quoted(_PUNCTUATION)})) / length({solid})::DOUBLE END)"
    brackets = f"len(regexp_extract_all({q}, {T.quoted(_BRACKETS)}))"
    one = rf"(NOT regexp_matches({q}, '\s') AND length({q}) >= 3 AND {hits(_IDENTIFIER)} AND ({hits(_PATHY)} OR ({hits(_SEPARATOR)} AND {hits(_LETTER)}) OR {hits(_HUMP)} OR {hits(_CAPITALIZED)}))"
    pl += f" + CASE WHEN {brackets} >= 4 AND length({q}) <= 500 THEN least(4, 1 + {brackets} // 4) ELSE 0 END + CASE WHEN {ratio} >= 0.11 THEN 3 ELSE 0 END + CASE WHEN {one} THEN 3 ELSE 0 END"
    nl += f" + CASE WHEN {ratio} < 0.04 AND length({q}) >= 36 THEN 1 ELSE 0 END"
    return f"CASE WHEN coalesce({q}, '') = '' THEN 'nl' WHEN ({pl}) > ({nl}) THEN 'pl' ELSE 'nl' END"


def depths(mode: Column, k: int, cfg: C.Config = C.Config()) -> dict[str, Column]:
    """How many candidates each channel recalls."""
    base = max(3 * k, k) if cfg.dense_top_n is None else max(cfg.dense_top_n, k)
    up = lambda n, by: F.ceil(F.lit(float(n)) * by).cast("int")
    pl = mode == "pl"
    return {
        "dense_depth": F.greatest(F.lit(k), F.when(pl, F.floor(F.lit(float(base)) * C.DENSE_PL_MULT).cast("int")).otherwise(up(base, C.DENSE_NL_MULT))),
        "bm25_depth": F.when(pl, F.greatest(F.lit(cfg.bm25_top_n), up(cfg.bm25_top_n, C.SPARSE_PL_MULT))).otherwise(F.lit(cfg.bm25_top_n)),
        "lexical_depth": F.when(pl, up(4 * k, C.SPARSE_PL_MULT)).otherwise(F.lit(4 * k)),
    }


def weights(intent: Column, mode: Column, cfg: C.Config = C.Config()) -> dict[str, Column]:
    """Weights of both fusion modes."""
    locate, nl = intent == "locate", mode == "nl"
    nudge = F.when(nl, C.NUDGE).otherwise(-C.NUDGE)
    clamp = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    semantic = clamp(F.when(locate, 0.45).otherwise(0.75) + nudge, C.SEMANTIC_MIN, C.SEMANTIC_MAX)
    lexical = clamp(F.when(locate, 0.55).otherwise(0.25) - nudge, C.LEXICAL_MIN, C.LEXICAL_MAX)
    bm25 = F.when(locate, 1.0).otherwise(cfg.rrf_explain_bm25_weight) * F.when(nl, C.RRF_NL_BM25).otherwise(C.RRF_PL_BM25)
    return {
        "semantic_weight": semantic / (semantic + lexical),
        "lexical_weight": lexical / (semantic + lexical),
        "rrf_dense_weight": F.when(nl, C.RRF_NL_DENSE).otherwise(C.RRF_PL_DENSE),
        "rrf_bm25_weight": F.least(F.lit(C.RRF_WEIGHT_MAX), bm25),
    }


def allowed(k: Column) -> Column:
    """Whether so many results may be asked for."""
    return k.between(*TOP_K)


def classify(questions: DataFrame, k: int = C.DEFAULT_TOP_K, cfg: C.Config = C.Config(), text_col: str = "question") -> DataFrame:
    """Questions with ``intent, modality``, depths, weights and retrieval ``tokens``: one projection."""
    if not TOP_K[0] <= k <= TOP_K[1]:
        raise ValueError(f"top_k must be between {TOP_K[0]} and {TOP_K[1]}")
    q = F.col(text_col)
    out = questions.withColumns({"intent": T.detect_intent(q), "modality": modality(q, cfg.query_modality), "tokens": T.question_tokens(q)})
    return out.withColumns(depths(F.col("modality"), k, cfg)).withColumns(weights(F.col("intent"), F.col("modality"), cfg))


#: DuckDB's expressions for the depths and weights of top_k 5, of columns ``intent`` and ``modality``.
SQL_DEPTHS = "CASE WHEN modality = 'pl' THEN 14 ELSE 17 END::INT AS dense_depth, CASE WHEN modality = 'pl' THEN 23 ELSE 20 END::INT AS bm25_depth, CASE WHEN modality = 'pl' THEN 23 ELSE 20 END::INT AS lexical_depth"
SQL_WEIGHTS = """
CASE WHEN intent = 'locate' THEN CASE WHEN modality = 'nl' THEN 0.53 ELSE 0.37 END ELSE CASE WHEN modality = 'nl' THEN 0.83 ELSE 0.67 END END::DOUBLE AS semantic_weight,
CASE WHEN intent = 'locate' THEN CASE WHEN modality = 'nl' THEN 0.47 ELSE 0.63 END ELSE CASE WHEN modality = 'nl' THEN 0.17 ELSE 0.33 END END::DOUBLE AS lexical_weight,
CASE WHEN modality = 'nl' THEN 1.1 ELSE 0.92 END::DOUBLE AS rrf_dense_weight,
(CASE WHEN intent = 'locate' THEN 1.0 ELSE 0.35 END * CASE WHEN modality = 'nl' THEN 0.88 ELSE 1.14 END)::DOUBLE AS rrf_bm25_weight"""

"""Text functions as column expressions, with the SQL that an oracle runs for the same rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that the retrieval rules are made of.
STOP_WORDS = ("what", "where", "which", "how", "when", "with", "from", "that", "this", "以及", "如何", "什么", "在哪", "哪里", "定义", "逻辑", "调用", "链路")
QUESTION_TOKEN = "[a-z0-9_./-]{2,}|[一-龥]{2,}"
MATCH_TOKEN = "[一-鿿]+|[A-Za-z0-9][A-Za-z0-9._-]*"
LOCATE = "哪里|在哪|定义|位于|路径|route|api|文件|模块|调用链|链路|where|defined"
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".swift", ".kt")
IGNORED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "__pycache__", ".next", "vendor", ".venv", "target", "bin", "obj")
IGNORED_FILES = (r"\.lock\z", r"\.min\.(js|css)\z", r"\.map\z", r"\.(png|jpg|jpeg|gif|ico|svg|woff|woff2|ttf|eot)\z")
IMPORT_CAP, ELLIPSIS = 800, "…"
#: What splits words for full-text search.
BREAK = r"[^\p{L}\p{N}]+"

#: Letters whose diacritics fold, by Unicode decomposition.
_FOLDED = {c: b for c in map(chr, range(0xC0, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()}
FOLD_FROM, FOLD_TO = "".join(_FOLDED), "".join(_FOLDED.values())


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fts_terms(body: Column) -> Column:
    """Terms in order: lower case, diacritics folded, split at all that is no letter or digit."""
    return F.filter(F.split(F.translate(F.lower(body), FOLD_FROM, FOLD_TO), BREAK), lambda t: t != "")


def sql_fts_terms(body: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower({body})), '{BREAK}'), lambda t: t <> '')"


def question_tokens(question: Column) -> Column:
    """Distinct retrieval tokens in order of appearance, without stop words."""
    found = F.regexp_extract_all(F.lower(question), F.lit(QUESTION_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOP_WORDS)))


def sql_distinct_in_order(items: str) -> str:
    return f"(SELECT coalesce(list(x ORDER BY k), []) FROM (SELECT x, min(k) AS k FROM (SELECT unnest({items}) AS x, generate_subscripts({items}, 1) AS k) GROUP BY x))"


def sql_question_tokens(question: str) -> str:
    stop = ", ".join(map(quoted, STOP_WORDS))
    return f"list_filter(regexp_extract_all(lower({question}), '{QUESTION_TOKEN}'), lambda t: t NOT IN ({stop}))"


def or_match(tokens: Column) -> Column:
    """Phrase-quoted tokens joined by OR; null if there are none."""
    return F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it, also in functions of elements."""
    return F.transform(F.array(value), use)[0]


def match_tokens(question: Column) -> Column:
    """Tokens of a free query: case kept, ASCII duplicates dropped whatever their case."""
    found = F.regexp_extract_all(F.trim(question), F.lit(MATCH_TOKEN), F.lit(0))
    placed = F.array_sort(F.transform(found, lambda t, k: F.struct(F.lower(t).alias("low"), k.alias("k"), t.alias("token"))))  # equal ones side by side, the first of them first
    first = bound(placed, lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["low"] != x["low"])))
    ordered = F.array_sort(F.transform(first, lambda x: F.struct(x["k"].alias("k"), x["token"].alias("token"))))
    return F.transform(ordered, lambda x: x["token"])


def and_match(question: Column) -> Column:
    """Phrase-quoted tokens side by side (all must match); null if there are none."""
    joined = F.array_join(F.transform(match_tokens(question), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")
    return bound(joined, lambda x: F.when(x != "", x))


def detect_intent(question: Column) -> Column:
    return F.when(F.lower(question).rlike(LOCATE), "locate").otherwise("explain")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))


def source_language(path: Column) -> Column:
    """Splitter language of a path; null where none is known."""
    ext = extension(path)
    return F.when(ext.isin(".ts", ".tsx", ".js", ".jsx"), "js").when(ext == ".py", "python")


def wanted_file(path: Column) -> Column:
    """Whether a relative path passes the directory, extension and file-name rules."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    dirs = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRECTORIES)
    return ~path.rlike(f"(^|/)({dirs})/") & extension(path).isin(*EXTENSIONS) & ~name.rlike("|".join(IGNORED_FILES))


def supported_git_url(url: Column) -> Column:
    return F.startswith(url, F.lit("https://")) | F.startswith(url, F.lit("git@"))


def source_kind(value: Column) -> Column:
    return F.when(supported_git_url(F.trim(value)), "git").otherwise("local")


def normalize_source(kind: Column, value: Column) -> Column:
    """Trimmed, without trailing slashes; a local root stays ``/``."""
    v = F.trim(value)
    cut = F.regexp_replace(v, r"/+\z", "")
    return F.when((kind == "local") & (cut == "") & F.startswith(v, F.lit("/")), "/").otherwise(cut)


def normalize_path(path: Column) -> Column:
    """Forward slashes, one leading ``./`` dropped."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def index_body(path: Column, summary: Column, kind: Column, name: Column, content: Column) -> Column:
    """What both channels index: file line, imports if any, type and name, blank line, content."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    middle = F.when(s == "", "\n").otherwise(F.concat(F.lit("\nImports:\n"), s, F.lit("\n\n")))
    return F.concat(F.lit("File: "), path, middle, kind, F.lit(": "), F.coalesce(name, F.lit("anonymous")), F.lit("\n\n"), content)


def cap_summary(summary: Column, cap: int = IMPORT_CAP) -> Column:
    s = F.trim(summary)
    return F.when(F.length(s) > cap, F.concat(F.rtrim(F.left(s, F.lit(cap))), F.lit(ELLIPSIS))).otherwise(s)


def shorten_path(path: Column, most: int) -> Column:
    return F.when((F.lit(most) <= 1) | (F.length(path) <= most), path).otherwise(F.concat(F.lit(ELLIPSIS), F.right(path, F.lit(most - 1))))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))

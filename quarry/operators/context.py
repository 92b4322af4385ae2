"""Context packing: ranked results into one text of at most four characters a token.

Each way to write headers is an entry of a ladder, from the fullest to the narrowest. How long the headers of a question's first
results are under each follows from lengths alone, so the choice is an expression over a question's results: as many of them as
fit in any way, written in the first way that fits. Results are shuffled once, by their question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config as C

# The frame of a section, the cap of imports, and the widths of paths and names that are tried in turn.
SEPARATOR, OPEN, CLOSE, IMPORT_CAP, ELLIPSIS = "\n\n---\n\n", "```\n", "\n```", 800, "…"
PATH_WIDTHS = (10_000, *range(240, 47, -24), *range(40, 21, -6))
BOTH_WIDTHS = (*((p, n) for p in range(120, 21, -24) for n in range(min(200, p + 80), 7, -14)), (22, 8))
#: (with imports, width of the path, width of the name), in the order of preference.
LADDER: tuple[tuple[bool, int | None, int | None], ...] = ((True, None, None), (False, None, None), *((False, p, None) for p in PATH_WIDTHS), *((False, p, n) for p, n in BOTH_WIDTHS))
FRAME = 1 + len(OPEN) + len(CLOSE)
#: Room of a lone section whose header is cut to fit: characters more than its path and name have, and the least width of both.
LONE_PATH, LONE_NAME, LEAST_PATH, LEAST_NAME = 120, 100, 280, 16


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _imports(summary: Column) -> Column:
    text = _stripped(F.coalesce(summary, F.lit("")))
    return F.when(F.length(text) > IMPORT_CAP, F.concat(F.regexp_replace(F.left(text, F.lit(IMPORT_CAP)), r"\s+\z", ""), F.lit(ELLIPSIS))).otherwise(text)


def _header(x: Column, path_width: Column, name_width: Column, imports: Column) -> Column:
    """The header of an item, its path's end and its name's beginning shown in so many characters, null for all."""
    path, name = x["path"], x["name"]
    shown = F.when(F.length(path) > path_width, F.concat(F.lit(ELLIPSIS), F.right(path, path_width - 1))).otherwise(path)
    called = F.when(F.length(name) > name_width, F.concat(F.left(name, name_width - 1), F.lit(ELLIPSIS))).otherwise(name)
    return F.concat(F.lit("Path: "), shown, F.lit("\n"), x["kind"], F.lit(": "), called, F.when(imports != "", F.concat(F.lit("\nImports:\n"), imports)).otherwise(""))


def _lone(x: Column, limit: Column) -> Column:
    """The header of a single section that no step of the ladder makes short enough: cut off, or where not even that has
    room, the type alone."""
    room = F.greatest(F.lit(0), limit - FRAME)
    wide = _header(x, F.least(F.length(x["path"]) + LONE_PATH, F.greatest(F.lit(LEAST_PATH), room)), F.least(F.length(x["name"]) + LONE_NAME, F.greatest(F.lit(LEAST_NAME), room)), F.lit(""))
    text = F.when(room >= 4, wide).otherwise(F.concat(x["kind"], F.lit(f":{ELLIPSIS}")))
    return F.regexp_replace(F.left(text, F.greatest(F.lit(1), room)), r"\s+\z", "")


def pack_results(results: DataFrame, max_tokens: int = C.MAX_CONTEXT_TOKENS) -> DataFrame:
    """``(question_id, n_results, context)``; results carry ``rank`` and their payload, ``import_summary`` if wanted.

    Sections follow the ranks; their bodies are filled in that order until the budget is used up. A question for whose first
    result there is no room has an empty context. Null paths, types and contents are empty, a chunk without a name is anonymous."""
    return pack_budgets(results, [max_tokens]).select("question_id", "n_results", "context")


def pack_budgets(results: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """``(tokens, question_id, n_results, context)``: :func:`pack_results` for each of several budgets. Results are read, shuffled
    and measured once, whatever the number of budgets."""
    summary = F.col("import_summary") if "import_summary" in results.columns else F.lit(None).cast("string")
    columns = {"path": F.coalesce("file_path", F.lit("")), "kind": F.coalesce("chunk_type", F.lit("")), "name": F.coalesce("chunk_name", F.lit("anonymous")), "content": F.coalesce("content", F.lit("")), "imports": _imports(summary)}
    item = F.struct("rank", *(c.alias(k) for k, c in columns.items()))
    grouped = results.select("question_id", item.alias("item")).groupBy("question_id").agg(F.sort_array(F.collect_list("item")).alias("items"))  # a question's top k
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(i).alias("full"), F.lit(p).cast("int").alias("path_width"), F.lit(n).cast("int").alias("name_width")) for k, (i, p, n) in enumerate(LADDER)))
    measured = grouped.withColumn("sizes", F.transform("items", lambda x: F.struct(*(F.length(x[c]).alias(c) for c in columns))))
    short = lambda size, width: F.least(size, F.coalesce(width, size))

    def upto(step: Column) -> Column:
        """The size without bodies of the first item, of the first two, and so on, with headers of this step."""

        def add(held: Column, x: Column) -> Column:
            header = 9 + short(x["path"], step["path_width"]) + x["kind"] + short(x["name"], step["name_width"]) + F.when(step["full"] & (x["imports"] > 0), 10 + x["imports"]).otherwise(0)
            return F.array_append(held, F.coalesce(F.get(held, F.size(held) - 1) + len(SEPARATOR), F.lit(0)) + header + FRAME)

        return F.aggregate("sizes", F.array().cast("array<int>"), add)

    tried = measured.withColumn("upto", F.transform(steps, upto))
    asked = tried.withColumn("tokens", F.explode(F.array(*(F.lit(b) for b in budgets)))).withColumn("limit", F.greatest(F.lit(1), 4 * F.col("tokens")))

    def fitting(sizes: Column, k: Column) -> Column:
        """How many of the first items fit, the step in the order of preference, and their size."""
        fit = F.filter(sizes, lambda size: size <= F.col("limit"))
        return F.struct(F.size(fit).alias("n"), (-k).alias("order"), F.coalesce(F.array_max(fit), F.lit(0)).alias("size"))

    chosen = asked.withColumn("best", F.array_max(F.transform("upto", fitting)))  # most items, then the first step
    chosen = chosen.select("tokens", "limit", "question_id", "items", "best", F.get(steps, -F.col("best.order")).alias("step"))
    fits = F.col("best.n") > 0
    room = F.col("limit") - F.when(fits, F.col("best.size")).otherwise(F.length(_lone(F.col("items")[0], F.col("limit"))) + FRAME)
    placed = chosen.withColumn("room", room).withColumn("kept", F.slice("items", F.lit(1), F.greatest(F.lit(1), F.col("best.n"))))

    def section(x: Column, k: Column) -> Column:
        written = _header(x, F.col("step.path_width"), F.col("step.name_width"), F.when(F.col("step.full"), x["imports"]).otherwise(""))
        used = F.aggregate(F.slice("kept", F.lit(1), k), F.lit(0).cast("long"), lambda n, y: n + F.length(y["content"]))
        body = F.left(x["content"], F.greatest(F.lit(0), F.col("room") - used).cast("int"))
        return F.concat(F.when(fits, written).otherwise(_lone(x, F.col("limit"))), F.lit(f"\n{OPEN}"), body, F.lit(CLOSE))

    text = F.when(F.col("room") >= 0, F.array_join(F.transform("kept", section), SEPARATOR)).otherwise("")
    return placed.select("tokens", "question_id", F.size("items").alias("n_results"), text.alias("context"))


def body_budget(results: DataFrame, budget: int | Column, keys: list[str], order: list[str]) -> DataFrame:
    """Results with ``taken``, the characters of their content that a greedy fill in order takes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("content", F.lit("")))
    used = F.coalesce(F.sum(size).over(w), F.lit(0))
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return results.withColumn("taken", F.greatest(F.lit(0), F.least(size, most - used)).cast("long"))


def prompt(question: Column, context: Column) -> Column:
    """System rules, context and question as one text."""
    rules = "Answer from the given code only. Name the files that you rely on. Say so if the context doesn't tell."
    return F.concat(F.lit(f"[system]\n{rules}\n\n[context]\n"), context, F.lit("\n\n[question]\n"), question)

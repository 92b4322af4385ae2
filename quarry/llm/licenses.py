"""License scans: texts against templates by sparse TF-IDF cosine, then inheritance.

Whole texts, headers and licence files alike, are looked through in overlapping windows of terms; templates,
short notices and full licence texts, are cut the same way. A vector holds the terms that any template has;
document frequencies come from all files. A window that reaches the threshold must hold one of the heaviest
terms of a template's window, those without which the rest could not reach it (the Cauchy-Schwarz bound), so
only windows around such terms are built, and none is lost. Equal windows are scored once. A file's licence is
that of the windows' best sum. A file without one takes that of the nearest ancestor directory in which a
licence file lies; directories meet their ancestors by joins on paths.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Identifiers and the usual short notices of public licences.
TEMPLATES = (
    ("AGPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("BSD-2-Clause", "released under the bsd 2 clause simplified license"),
    ("BSD-3-Clause", "released under the bsd 3 clause license redistribution and use in source and binary forms with or without modification are permitted"),
    ("CC-BY-4.0", "licensed under cc by 4.0 creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal license"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("ISC", "released under the isc license permission to use copy modify and or distribute this software for any purpose"),
    ("LGPL-3.0", "this library is licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software mit license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain unlicense"),
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "BSD-3-Clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "Apache-2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "GPL-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "GPL-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "MPL-2.0",
        "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    ),
)
#: What names a licence file of the query's tree; how licence files are named; terms of a text.
HINT = r"licen[sc]e|copyright|spdx|public domain|all rights reserved|creative commons"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
#: Terms of a window and from one to the next; least cosine.
WIDTH, STRIDE, THRESHOLD = 48, 12, 0.6


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _last(n: Column) -> Column:
    """The last window of so many terms; the first one is 0 and there always is one."""
    return F.greatest(F.lit(0), F.ceil((n - WIDTH) / STRIDE)).cast("int")


def _weights(terms: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """TF-IDF weights of terms, each text's vector scaled to length one: a term counts ``1 + ln(count)``."""
    tf = terms.groupBy(*keys, "term").count()
    w = tf.join(F.broadcast(idf), "term").select(*keys, "term", ((1 + F.log("count")) * F.col("idf")).alias("w"))  # a row per template term
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def template_windows(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``(template, k, license, term)``: the terms of each window of each template."""
    marks = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, t string")
    marks = marks.withColumn("terms", terms_of(F.col("t"))).withColumn("k", F.explode(F.sequence(F.lit(0), _last(F.size("terms")))))
    return marks.select("template", "k", "license", F.explode(F.slice("terms", F.col("k") * STRIDE + 1, WIDTH)).alias("term"))


def anchors(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(term)``: of each vector ``(template, k, term, w)`` the heaviest terms; those left over have a length under the
    threshold, so that a text without any of them can't reach it."""
    before = Window.partitionBy("template", "k").orderBy(F.desc("w"), "term").rowsBetween(Window.unboundedPreceding, -1)
    left = 1 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(before), F.lit(0.0))
    return vectors.withColumn("left", left).where(F.col("left") >= threshold * threshold - 1e-9).select("term").distinct()


def windows(files: DataFrame, heavy: list[str], known: list[str]) -> DataFrame:
    """``(file, notice, times)``: the windows of ``text`` around a heavy term, as their known terms in alphabetical order,
    and how many of a file's are alike."""
    some = files.withColumn("terms", terms_of(F.col("text"))).where(F.arrays_overlap("terms", F.array(*map(F.lit, heavy))))
    places = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.get("terms", i).isin(heavy))
    last = _last(F.size("terms"))
    ks = F.transform(places, lambda p: F.sequence(F.least(last, F.greatest(F.lit(0), F.floor((p - WIDTH) / STRIDE).cast("int") + 1)), F.least(last, F.floor(p / STRIDE).cast("int"))))
    each = some.select("file", "terms", F.explode(F.array_distinct(F.flatten(ks))).alias("k"))
    own = F.filter(F.slice("terms", F.col("k") * STRIDE + 1, WIDTH), lambda t: t.isin(known))
    return each.select("file", F.array_join(F.sort_array(own), " ").alias("notice")).groupBy("file", "notice").agg(F.count("*").alias("times"))


def scored_windows(files: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """``(file, license, cosine, total)``: for each licence that a window of a file reaches the threshold with, the best
    cosine of a window, and the sum of the windows' best cosines. A term's weight is ``1 + ln(count)`` times ``ln(1 + (n + 1) / (df + 1))`` over the n files."""
    spark = files.sparkSession
    marked = template_windows(spark, templates)
    known = sorted({t for (t,) in marked.select("term").distinct().collect()})  # the templates' terms: a fixed, small set
    n = files.count()
    own = files.select(F.explode(F.array_intersect(terms_of(F.col("text")), F.array(*map(F.lit, known)))).alias("term"))
    df = cut(own.groupBy("term").agg(F.count("*").alias("df")))
    idf = marked.select("term").distinct().join(F.broadcast(df), "term", "left").select("term", F.log(1 + F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    t = cut(_weights(marked, ["template", "k", "license"], idf))
    heavy = sorted(r[0] for r in anchors(t, threshold).collect())
    found = cut(windows(files, heavy, known))
    terms = found.select("notice").distinct().select("notice", F.explode(F.split("notice", " ")).alias("term"))
    w = _weights(terms, ["notice"], idf)
    pairs = w.join(F.broadcast(t.select("template", "k", "license", "term", F.col("w").alias("tw"))), "term")
    cos = pairs.groupBy("notice", "template", "k", "license").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("cosine"))
    best = cos.where(F.col("cosine") >= threshold).groupBy("notice", "license").agg(F.max("cosine").alias("cosine"))
    met = found.join(best, "notice").groupBy("file", "license")
    return met.agg(F.max("cosine").alias("cosine"), F.round(F.sum(F.col("cosine") * F.col("times")), 6).alias("total"))


def _ancestors(path: Column) -> Column:
    """The directories above a path, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """``(path, license, cosine, origin, inherited_from)``, a row per distinct path.

    ``origin`` is ``own`` (a window of the file scores ``threshold`` or more; of several licences that with the greatest sum
    of its windows' cosines, then the best one, then the first by name), ``inherited`` (``inherited_from`` is the nearest ancestor directory, the file's own
    directory first, holding a licence file with a licence; of several there the highest cosine,
    then the smallest identifier) or ``none``. Texts of one path are taken together; a null text
    has no terms; rows with a null path are left out. An empty table gives no rows. Other
    columns are not read."""
    rows = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string").alias("file"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = cut(scored_windows(rows, templates, threshold).groupBy("file").agg(F.min(F.struct(F.negative("total").alias("t"), F.negative("cosine").alias("c"), "license")).alias("b")).select("file", "b.license", F.negative("b.c").alias("cosine")))
    paths = rows.select("file").distinct()
    known = cut(paths.join(own, "file", "left").withColumn("dir", F.array_join(F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1), "/")))
    lawful = known.where(F.col("file").rlike(license_file) & F.col("license").isNotNull())
    by_dir = lawful.groupBy("dir").agg(F.min_by("license", F.struct(F.negative("cosine"), "license")).alias("up_license"), F.max("cosine").alias("up_cosine"))
    wanting = known.where("license is null").select("dir").distinct()
    chain = wanting.select("dir", F.explode(_ancestors(F.concat("dir", F.when(F.col("dir") == "", "x").otherwise("/x")))).alias("up"))
    near = chain.join(by_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "up_license", "up_cosine"), F.length("up")).alias("near"))
    out = known.join(near, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("file").alias("path"),
        F.coalesce("license", "near.up_license").alias("license"),
        F.coalesce("cosine", "near.up_cosine").alias("cosine"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near.up")).alias("inherited_from"),
    )


def tree_path(doc_id: Column, source: Column, lang: Column, text: Column) -> Column:
    """The query's mapping of the documents table to a source tree: ``source/lang/shelf/id.txt``, 64
    documents to a shelf. A document with a licence line is a licence file and lies on its shelf,
    in its language's or in its source's folder."""
    shelf = F.floor(doc_id / 64).cast("long").cast("string")
    name = doc_id.cast("string")
    lawful = F.coalesce(F.lower(text).rlike(HINT), F.lit(False))
    s, lg = F.coalesce(source, F.lit("unknown")), F.coalesce(lang, F.lit("unknown"))
    file = F.concat(F.lit("LICENSE-"), name, F.lit(".txt"))
    return (
        F.when(~lawful, F.concat_ws("/", s, lg, shelf, F.concat(name, F.lit(".txt"))))
        .when(doc_id % 3 == 0, F.concat_ws("/", s, lg, shelf, file))
        .when(doc_id % 3 == 1, F.concat_ws("/", s, lg, file))
        .otherwise(F.concat_ws("/", s, file))
    )


_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
#: DuckDB's version of the query over ``tree_path``.
SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, coalesce(regexp_matches(lower(text), '{HINT}'), false) AS lawful FROM documents),
f AS (SELECT DISTINCT CASE WHEN NOT lawful THEN s || '/' || l || '/' || (doc_id // 64) || '/' || doc_id || '.txt'
    WHEN doc_id % 3 = 0 THEN s || '/' || l || '/' || (doc_id // 64) || '/LICENSE-' || doc_id || '.txt'
    WHEN doc_id % 3 = 1 THEN s || '/' || l || '/LICENSE-' || doc_id || '.txt' ELSE s || '/LICENSE-' || doc_id || '.txt' END AS file, text, lawful FROM d),
n AS (SELECT count(*) AS n FROM d),
tt AS (SELECT file, regexp_extract_all(lower(coalesce(text, '')), '{TERM}') AS t FROM f),
mt AS (SELECT template, license, regexp_extract_all(t, '{TERM}') AS t FROM (VALUES {_VALUES}) v(template, license, t)),
mw AS (SELECT template, license, unnest(range(0, 1 + greatest(0, ceil((len(t) - {WIDTH}) / {STRIDE}))::INT)) AS k, t FROM mt),
marked AS (SELECT template, license, k, unnest(list_slice(t, k * {STRIDE} + 1, k * {STRIDE} + {WIDTH})) AS term FROM mw),
vocabulary AS (SELECT DISTINCT term FROM marked),
df AS (SELECT term, count(*) AS df FROM (SELECT file, unnest(list_distinct(t)) AS term FROM tt) JOIN vocabulary USING (term) GROUP BY 1),
idf AS (SELECT term, ln(1 + (n + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS idf FROM vocabulary LEFT JOIN df USING (term), n),
tw0 AS (SELECT template, license, k, term, (1 + ln(count(*))) * any_value(idf) AS w FROM marked JOIN idf USING (term) GROUP BY 1, 2, 3, 4),
tw AS (SELECT template, license, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY template, k)) AS tw FROM tw0),
fw AS (SELECT file, unnest(range(0, 1 + greatest(0, ceil((len(t) - {WIDTH}) / {STRIDE}))::INT)) AS k, t FROM tt),
terms AS (SELECT file, k AS fk, unnest(list_slice(t, k * {STRIDE} + 1, k * {STRIDE} + {WIDTH})) AS term FROM fw),
w0 AS (SELECT file, fk, term, (1 + ln(count(*))) * any_value(idf) AS w FROM terms JOIN idf USING (term) GROUP BY 1, 2, 3),
w AS (SELECT file, fk, term, w / sqrt(sum(w * w) OVER (PARTITION BY file, fk)) AS w FROM w0),
cos AS (SELECT file, fk, template, license, k, round(sum(w * tw), 6) AS cosine FROM w JOIN tw USING (term) GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT file, fk, license, max(cosine) AS cosine FROM cos WHERE cosine >= {THRESHOLD} GROUP BY 1, 2, 3),
summed AS (SELECT file, license, max(cosine) AS cosine, round(sum(cosine), 6) AS total FROM scored GROUP BY 1, 2),
own AS (SELECT file, license, cosine FROM summed QUALIFY row_number() OVER (PARTITION BY file ORDER BY total DESC, cosine DESC, license) = 1),
known AS (SELECT DISTINCT f.file, license, cosine, regexp_replace(f.file, '/[^/]*$', '') AS dir FROM f LEFT JOIN own USING (file)),
by_dir AS (SELECT dir AS up, license AS ul, cosine AS uc FROM known WHERE license IS NOT NULL AND regexp_matches(file, '(^|/)(LICENSE|LICENCE|COPYING|UNLICENSE)[^/]*$') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
near AS (SELECT k.file, up, ul, uc FROM known k JOIN by_dir ON k.dir = up OR starts_with(k.dir, up || '/') WHERE license IS NULL QUALIFY row_number() OVER (PARTITION BY k.file ORDER BY length(up) DESC) = 1)
SELECT k.file AS path, coalesce(license, ul) AS license, coalesce(cosine, uc) AS cosine,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN up IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, up AS inherited_from
FROM known k LEFT JOIN near USING (file)
"""

"""License scans by diagonal voting: joins, groupings and windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, text_of

#: All that is not in a word, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Of a template's pairs beyond the first FIRM two in five may be missing.
FIRM = 4
#: Label and phrase; a phrase counts where its words stand consecutively.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Label and wording of further templates, found by the share of their word pairs on
#: neighbouring diagonals. The pairs of a word with a star must all be there: it tells the wording
#: from its kin.
TEMPLATES = (
    # short notices
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution *sharealike"),
    ("cc-by-nd", "licensed under a creative commons attribution *noderivatives"),
    ("cc-by-nd", "licensed under a creative commons attribution *noderivs"),
    ("cc-by-nc", "licensed under a creative commons attribution *noncommercial"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution *noncommercial *sharealike"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution *noncommercial *noderivatives"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution *noncommercial *noderivs"),
    ("cc-by-sa", "licensed under cc by *sa"),
    ("cc-by-nd", "licensed under cc by *nd"),
    ("cc-by-nc", "licensed under cc by *nc"),
    ("cc-by-nc-sa", "licensed under cc by *nc *sa"),
    ("cc-by-nc-nd", "licensed under cc by *nc *nd"),
    ("cc0", "to the extent possible under law the author has *waived all *copyright and related or neighboring rights to this work"),
    ("mit", "permission is hereby granted free of charge to any person *obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without *fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "*redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "licensed under the *apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu *general public license as published by the free software foundation"),
    ("gpl-2", "this work is licensed under the gnu *general public license version *2"),
    ("gpl-3", "this work is licensed under the gnu *general public license version *3"),
    ("lgpl", "under the terms of the gnu *lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu *affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the *mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the *eclipse public license"),
    ("unlicense", "this is free and *unencumbered software released into the public domain"),
    # whole wordings
    ("mit", "permission is hereby granted free of charge to any person *obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must *reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must *reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "the software is provided as is and the author *disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("zlib", "permission is granted to *anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or *organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("apache", "licensed under the *apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu *general public license as published by the free software foundation either version *2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu *general public license as published by the free software foundation either version *3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu *general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu *lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu *affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the *mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any *means"),
)
#: Spans are compared that share a stretch of so many words.
STRETCH = 64


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z (after lower-casing) and non-ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _pairs(words: Column) -> Column:
    """The rolling pairs of words with their hashes; none for a text of fewer."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), pair)


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(h, a, b, template, label, base, at, must, musts, grams): every place of every template; a row
    for each word pair of a fixed list, so about a thousand rows."""
    given = [(*p, True) for p in phrases] + [(*t, False) for t in templates]
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("text"), F.lit(c).alias("base")) for i, (a, b, c) in enumerate(given)])
    starred = F.transform(F.split("text", " "), lambda w: w.startswith("*"))
    n = F.size("words") - 1
    must = F.zip_with(F.slice("starred", 1, n), F.slice("starred", 2, n), lambda a, b: a | b)
    held = spark.range(1).select(F.inline(rows)).withColumn("starred", starred).withColumn("words", words_of(F.col("text"))).withColumn("must", must)
    held = held.withColumn("musts", F.size(F.filter("must", lambda m: m))).withColumn("grams", n)
    return held.select("template", "label", "base", "grams", "musts", "must", F.posexplode(_pairs(F.col("words"))).alias("at", "p")).select(
        "p.h", "p.a", "p.b", "template", "label", "base", "at", F.element_at("must", F.col("at") + 1).alias("must"), "musts", "grams"
    )


def scan(
    docs: DataFrame,
    phrases=PHRASES,
    templates=TEMPLATES,
    gap: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for
    each row of ``docs``.

    Every word pair of every text is joined by its hash to the places of the templates (a fixed list,
    so it is broadcast) and compared word by word. Hits vote for their diagonal, the offset of
    text to template. A phrase stands where a diagonal has all its pairs. Of the longer
    templates, diagonals at most ``gap`` apart in a row are merged (words put in or left out), and a
    span counts if enough of the template's pairs are on it: all pairs of its starred words, and for
    every length but two in five of those beyond the first FIRM. Of spans that lie over each
    other in a text only those stay over which none has more votes (ties: the earlier template);
    phrases take no part in that. score is the largest share found, 1 for a phrase; spans are
    (start, label, share). Null is the empty text (no words, empty labels, score 0); rows that
    repeat id and text are scanned as one and each gets the result; a null id is a value like
    another. An empty table gives an empty one. A very long text is split whole; its pairs are
    rows of their own.
    """
    spark = docs.sparkSession
    key = ["doc_id", "text_hash"]
    text = text_of(text_col)
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    pairs = words.select(*key, F.posexplode(_pairs(F.col("words"))).alias("pos", "p")).select(*key, "pos", "p.*")
    places = template_places(spark, phrases, templates).withColumnsRenamed({"a": "t_a", "b": "t_b"})
    of = ["template", "label", "base", "musts", "grams"]
    hits = (
        pairs.join(F.broadcast(places), "h")
        .filter((F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")))
        .select(*key, *of, "at", "must", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    votes = hits.groupBy(*key, *of, "diagonal").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("must"), F.col("at"))).alias("must"),
        (F.col("diagonal") + F.min("at")).alias("low"), (F.col("diagonal") + F.max("at") + 1).alias("high"),
    )
    by_diagonal = Window.partitionBy(*key, "template").orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > gap)
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = (
        votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(by_diagonal))
        .groupBy(*key, *of, "span")
        .agg(distinct("at").alias("votes"), distinct("must").alias("held"), F.min("diagonal").alias("start"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("share", F.col("votes") / F.col("grams"))
        .filter(
            F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(
                (F.col("held") == F.col("musts")) & (5 * (F.col("grams") - F.col("votes")) <= 2 * F.greatest(F.col("grams") - FIRM, F.lit(0)))
            )
        )
    )
    spans = materialise(spans, "license-spans")
    # at most a few spans of each template lie over a stretch, so they are held against each other there
    other = spans.filter("NOT base").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor(F.col("high") / STRETCH))))
    x, y = ([F.col(c).alias(f"{s}_{c}") for c in (*key, "stretch", "template", "span", "votes", "low", "high")] for s in "xy")
    better = (F.col("y_votes") > F.col("x_votes")) | ((F.col("y_votes") == F.col("x_votes")) & (F.col("y_template") < F.col("x_template")))
    meet = [F.col("x_doc_id").eqNullSafe(F.col("y_doc_id")), F.col("x_text_hash") == F.col("y_text_hash"), F.col("x_stretch") == F.col("y_stretch")]
    beaten = other.select(*x).join(other.select(*y), meet).filter((F.col("y_low") <= F.col("x_high")) & (F.col("x_low") <= F.col("y_high")) & better)
    beaten = beaten.select(*[F.col(f"x_{c}").alias(f"x_{c}") for c in (*key, "template", "span")]).distinct()
    lost = [F.col("doc_id").eqNullSafe(F.col("x_doc_id")), *[F.col(c) == F.col(f"x_{c}") for c in ("text_hash", "template", "span")]]
    spans = spans.join(beaten, lost, "left_anti")
    named = lambda which: F.concat_ws(",", F.sort_array(F.collect_set(F.when(which, F.col("label")))))
    found = spans.groupBy(*key).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        named(F.col("base")).alias("base_labels"),
        named(F.lit(True)).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "label", "share"))).alias("spans"),
    )
    rows = words.select(*key, F.size("words").cast("long").alias("n_words")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash"))
    empty = F.lit("")
    return rows.join(found.alias("f"), same, "left").select(
        "r.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", empty).alias("base_labels"),
        F.coalesce("labels", empty).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,label:string,share:double>>")).alias("spans"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(phrases=PHRASES, templates=TEMPLATES, gap: int = 4) -> str:
    """The same scan of ``documents`` (doc_id unique) in DuckDB's SQL."""
    given = [(*p, True) for p in phrases] + [(*t, False) for t in templates]
    values = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)}, {c})" for i, (a, b, c) in enumerate(given))
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    words = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w != '')"
    return f"""
        WITH d AS (SELECT doc_id, {words.format(f"translate(coalesce(text, ''), {upper}, lower({upper}))")} AS w FROM documents),
        t AS (SELECT template, label, base, string_split(replace(txt, '*', ''), ' ') AS w, string_split(txt, ' ') AS marked FROM (VALUES {values}) v(template, label, txt, base)),
        places AS (SELECT template, label, base, len(w) - 1 AS grams, i - 1 AS place, w[i] AS a, w[i + 1] AS b, starts_with(marked[i], '*') OR starts_with(marked[i + 1], '*') AS must
          FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
        musts AS (SELECT template, count(*) FILTER (must) AS musts FROM places GROUP BY template),
        pairs AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
        hits AS (SELECT DISTINCT doc_id, template, label, base, grams, place, must, pos - place AS diagonal FROM pairs JOIN places USING (a, b)),
        apart AS (SELECT *, base OR coalesce(diagonal - lag(diagonal) OVER w > {gap}, true) AS new
          FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM hits) WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
        numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
        spans AS (SELECT doc_id, template, label, h.base AS base, grams, span, count(DISTINCT place) AS votes, count(DISTINCT place) FILTER (must) AS held, min(h.diagonal) AS start,
            min(h.diagonal + place) AS low, max(h.diagonal + place) + 1 AS high
          FROM hits h JOIN numbered n USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, h.base, grams, span),
        enough AS (SELECT *, votes / grams::DOUBLE AS share FROM spans JOIN musts USING (template)
          WHERE CASE WHEN base THEN votes = grams ELSE held = musts AND 5 * (grams - votes) <= 2 * greatest(grams - {FIRM}, 0) END),
        found AS (SELECT * FROM enough x WHERE base OR NOT EXISTS (SELECT 1 FROM enough y WHERE y.doc_id = x.doc_id AND NOT y.base AND y.low <= x.high AND x.low <= y.high
          AND (y.votes > x.votes OR y.votes = x.votes AND y.template < x.template)))
        SELECT doc_id, max(len(w)) AS n_words, count(label) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
          coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
          coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
        FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id"""

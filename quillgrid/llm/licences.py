"""Licence notices by paragraph: a sparse n-gram classifier and templates.

A paragraph is a run of neighbouring lines that hold a cue word, with at most one line
that holds none between two of them and no blank one: a notice that is wrapped is judged
whole.  Its lines are judged alone too, and what they confirm (two licences in two
lines) stands before what the whole does.  Features are distinct word 1- to 3-grams that
hold a cue word; a softmax regression over the licence families and an unknown class
is fitted, with L1 shrinkage, to seeded variations of the built-in templates
(words lost, added and replaced, prose around) and to lines that only share their
words.  Weights are whole thousandths, so sums are exact and the SQL twin agrees.
A prediction needs the calibrated probability ``floor``, the least at which at
least 99 in 100 predictions are right on variations of templates and other lines that
the model did not learn from (three folds); it is confirmed when a template
of its family shares ``overlap`` of its word pairs with the paragraph, and, for titles
of up to three pairs, has at least half of the paragraph's.

The main path is DataFrame functions only.  Lines without a cue word have no
feature and are passed over by one regular expression, which loses nothing.
Every distinct text is classified once, so a notice that a third of all documents
carry is one row until the results return, by a join that broadcasts the commonest; the
weights are a fixed table of a few thousand rows, whatever the input.

Defined cases: null and empty texts have no paragraph and get a row without
families; cue words without any known gram are unknown by the bias alone; a null doc_id
stays a row of its own group; rows that share a doc_id are taken together, equal
paragraphs at one place of theirs once, and each gets their result; a very long text is
scanned whole, and a run of any length is one paragraph; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import functools
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Wordings of well-known notices, titles and identifiers, in words.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is distributed under the terms of the affero general public license",
        "released under the agpl 3 0",
        "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx license identifier agpl 3 0 or later",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the apache license",
        "distributed under the apache software license 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "licensed under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "released under the bsd license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "spdx license identifier bsd 3 clause",
    ],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "spdx license identifier cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"],
    "cc0": ["released under cc0 1 0 universal", "dedicated to the public domain under cc0", "spdx license identifier cc0 1 0"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "free software you can redistribute it under the terms of the gnu general public license",
        "licensed under the gpl version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx license identifier gpl 3 0 or later",
    ],
    "isc": [
        "licensed under the isc license",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
        "spdx license identifier isc",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1",
        "this library is free software under the terms of the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "released under the lgpl 2 1",
        "spdx license identifier lgpl 2 1 or later",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "licensed under the mit license",
        "the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "spdx license identifier mit",
    ],
    "mpl": [
        "subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one",
        "spdx license identifier mpl 2 0",
    ],
}
FAMILIES = [*TEMPLATES, "unknown"]
_ELSE = ["all rights reserved", "a license is required to drive", "the driver license was issued by the state", "this license may not be transferred", "see the license file for details", "copyright of the authors", "licensed to the public by the owner", "released under a new version", "the terms of use apply", "the apache people of the plains", "she studied at mit", "version 2 of the report was released", "a gnu crossed the river", "free software is discussed here", "public domain", "use of this work is permitted for a fee", "distributed under special terms", "the commons is a public place", "attribution of the painting is unknown", "the mozilla browser was released", "proprietary license of the vendor", "you may redistribute this letter", "end user license agreement", "permission to copy was refused", "the committee discussed the license and rejected it", "the license of the software is discussed below", "software for any person", "the foundation published a letter", "a copy of the public notice", "the general modified the terms", "files of the project identifier", "source of the river", "the university released a report", "the clause in the contract was modified"]
_PLAIN = set("the of a is to by or and with without for any in it on are can you may not was that this under be an as at use work new all her his if one above must following met form deal list later either".split())
_NOISE = "on under river the letter of house morning and people may winter that which stone to green water for a work is part by paper story in time".split()
CUES = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split() if w not in _PLAIN and not w.isdigit() and len(w) > 1})
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _any_of(words: list[str]) -> str:
    """An alternation by common beginnings: few branches are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [k + (_any_of(rest) if any(rest) else "") for k, rest in sorted(by.items()) if k]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if "" in by else body


CUE = r"(?:^|[^a-z0-9])" + _any_of(CUES) + r"(?:$|[^a-z0-9])"
OVERLAP, TITLE = 600, 3  # of 1000; pairs of a title


def grams(words: list[str]) -> set[str]:
    out = (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return {g for g in out if any(w in _CUE_SET for w in g.split())}


_CUE_SET = set(CUES)


@functools.cache
def model(seed: int = 3, copies: int = 5, steps: int = 120, shrink: float = 0.002, folds: int = 3) -> tuple[tuple[tuple[str, tuple[int, ...]], ...], tuple[int, ...], float]:
    """((gram, weights), biases, floor): weights and biases in thousandths."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def varied(text: str) -> list[str]:
        words = [w for w in text.split() if rng.random() > 0.06]
        words = [_NOISE[rng.integers(len(_NOISE))] if rng.random() < 0.04 and w not in _CUE_SET else w for w in words]
        words = [str(rng.integers(1, 6)) if w.isdigit() and w != "0" else w for w in words]
        pad = lambda: [_NOISE[i] for i in rng.integers(0, len(_NOISE), rng.integers(0, 9))]
        return pad() + words + pad()

    lines, label, fold = [], [], []
    for k, family in enumerate(FAMILIES):
        for n, text in enumerate(TEMPLATES.get(family, _ELSE)):
            for i in range(copies):
                lines.append(text.split() if not i else varied(text))
                label.append(k)
                fold.append(n % folds)
    label, fold = np.array(label), np.array(fold)
    vocabulary = sorted({g for w in lines for g in grams(w)})
    at = {g: i for i, g in enumerate(vocabulary)}
    held_by = [sorted(at[g] for g in grams(w)) for w in lines]  # sparse rows
    y = np.eye(len(FAMILIES))[label]

    def cells(some):
        """Line and gram of every gram of some lines, and where each line and gram begins."""
        row = np.repeat(np.arange(len(some)), [len(held_by[i]) for i in some])
        col = np.concatenate([np.zeros(0, int), *(held_by[i] for i in some)]).astype(int)
        by = np.argsort(col, kind="stable")
        return col, row[by], np.unique(row, return_index=True), np.unique(col[by], return_index=True)

    def chance(x, n, w, b):
        z = np.tile(b, (n, 1))
        z[x[2][0]] += np.add.reduceat(w[x[0]], x[2][1])
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fitted(some, rate: float = 4.0):
        x, n = cells(some), len(some)
        w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
        for _ in range(steps):
            g = (chance(x, n, w, b) - y[some]) / n
            w[x[3][0]] -= rate * np.add.reduceat(g[x[1]], x[3][1])
            b -= rate * g.sum(0)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink * 0.1, 0)
        return w, b

    top, right, known = [], [], []
    for f in range(folds):
        apart = np.flatnonzero(fold == f)
        p = chance(cells(apart), len(apart), *fitted(np.flatnonzero(fold != f)))
        top.append(p.max(1))
        right.append(p.argmax(1) == label[apart])
        known.append(p.argmax(1) != len(FAMILIES) - 1)
    top, right, known = (np.concatenate(v) for v in (top, right, known))
    top, right = top[known], right[known]
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    floor = max(0.5, round(float(top[order][np.flatnonzero(share >= 0.99).max()]) - 1e-4, 3)) if (share >= 0.99).any() else 0.95
    w, b = fitted(np.arange(len(lines)))
    whole = np.rint(w * 1000).astype(int)
    held = [(vocabulary[i], tuple(int(v) for v in whole[i])) for i in np.flatnonzero(np.abs(whole).any(1))]
    return tuple(held), tuple(int(v) for v in np.rint(b * 1000)), min(floor, 0.95)


def _pairs(text: str) -> list[str]:
    w = text.split()
    return sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)})


def _word_grams(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def _sizes() -> list[tuple[str, int, int, int]]:
    """(family, template, pairs, most pairs of a paragraph that it confirms)."""
    return [(f, i, n, 2 * n if n <= TITLE else 1 << 30) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for n in [len(_pairs(t))]]


def classified(lines: DataFrame) -> DataFrame:
    """``line`` (distinct, lower-cased) to family, probability, overlap, confirmed."""
    spark = lines.sparkSession
    weights, bias, floor = model()
    n = len(FAMILIES)
    table = F.broadcast(_table(spark, [(g, list(w)) for g, w in weights], "gram string, w array<int>"))
    known = F.broadcast(_table(spark, [(f, i, p) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in _pairs(t)], "t_family string, t int, gram string"))
    size = F.broadcast(_table(spark, _sizes(), "t_family string, t int, pairs int, most int"))
    words = F.regexp_extract_all("line", F.lit("([a-z0-9]+)"), 1)
    one = lines.select("line").withColumn("words", words)
    every = one.select("line", F.explode(F.array_distinct(F.concat(*(_word_grams(F.col("words"), k) for k in (1, 2, 3))))).alias("gram"))
    # a gram without weights counts nothing; a line without any has the biases alone
    sums = every.join(table, "gram", "left").groupBy("line").agg(*(F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0)).alias(f"s{k}") for k in range(n)))
    z = [F.col(f"s{k}") + bias[k] for k in range(n)]
    top = F.greatest(*z)
    total = sum((F.exp((v - top) / 1000.0) for v in z), F.lit(0.0))
    first = F.coalesce(*(F.when(v == top, F.lit(FAMILIES[k])) for k, v in enumerate(z)))
    named = sums.select("line", first.alias("guess"), F.round(1 / total, 6).alias("probability"))
    # outer, as the optimizer would filter on the size of ``p`` before, with the words taken anew for each pair; the join drops the nulls
    pairs = one.select("line", F.array_distinct(_word_grams(F.col("words"), 2)).alias("p")).select("line", F.size("p").alias("own"), F.explode_outer("p").alias("gram"))
    shared = pairs.join(known, "gram").groupBy("line", "own", "t_family", "t").agg(F.count("*").alias("n")).join(size, ["t_family", "t"]).where("own <= most")
    shared = shared.groupBy("line", F.col("t_family").alias("guess")).agg(F.max(F.floor(F.col("n") * 1000 / F.col("pairs"))).alias("overlap"))
    sure = (F.col("probability") >= floor) & (F.col("guess") != "unknown")
    out = named.join(shared, ["line", "guess"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return out.select("line", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"), "probability", "overlap", (sure & (F.col("overlap") >= OVERLAP)).alias("confirmed"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, as literals of the plan (no Python data path)."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = ", ".join("(" + ", ".join(f"array({', '.join(map(str, v))})" if isinstance(v, list) else repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, run, whole, line): each paragraph of several lines as a whole,
    and every line of a paragraph that holds a cue word.  ``paragraph`` is the number of
    its first line, ``run`` a hash of its text."""
    text = _lower(F.col("text"))
    held = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike(CUE))
    held = held.select("doc_id", F.split("text", "\n").alias("lines"))
    held = held.select("doc_id", "lines", F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(CUE), i))).alias("at"))
    # where a paragraph begins, as places in ``at``
    blank = lambda k: ~F.get("lines", k).rlike("[^ \t\r]")
    step = lambda i, n: i - F.get("at", n - 1)
    goes_on = lambda i, n: (n > 0) & ((step(i, n) == 1) | ((step(i, n) == 2) & ~blank(i - 1)))
    held = held.select("doc_id", "lines", "at", F.array_compact(F.transform("at", lambda i, n: F.when(~goes_on(i, n), n))).alias("heads"))
    runs = F.transform("heads", lambda h, k: F.struct(F.get("at", h).alias("a"), F.get("at", F.coalesce(F.get("heads", k + 1), F.size("at")) - 1).alias("b")))
    held = held.select("doc_id", "lines", "at", F.explode(runs).alias("r"))
    held = held.select("doc_id", F.col("r.a").alias("paragraph"), F.slice("lines", F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1).alias("own"))
    held = held.select("doc_id", "paragraph", "own", F.array_join("own", "\n").alias("text"))
    whole = F.filter(F.array(F.struct((F.size("own") > 1).alias("whole"), F.col("text").alias("line"))), lambda x: x.whole)
    single = F.transform(F.filter("own", lambda x: x.rlike(CUE)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("line")))
    return held.select("doc_id", "paragraph", F.xxhash64("text").alias("run"), F.explode(F.concat(whole, single)).alias("u")).select("doc_id", "paragraph", "run", "u.whole", "u.line")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, run, whole, line, family, probability, overlap, confirmed)."""
    found = c.staged(paragraphs(docs), "paragraphs")
    distinct = c.staged(found.groupBy("line").agg(F.count("*").alias("_n")), "lines")
    judged = c.staged(classified(distinct).join(distinct, "line"), "judged")
    met = c.join_counted(found, judged, ["line"], "_n", found.count())
    return met.select("doc_id", "paragraph", "run", "whole", "line", "family", "probability", "overlap", "confirmed")


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, families, probability) of each paragraph: the families that its
    lines confirm, or else its whole; none where neither does."""
    each = scan(docs).groupBy("doc_id", "paragraph", "run").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("confirmed") & (F.col("whole") == k), F.col("family")))).alias(f"f{int(k)}") for k in (False, True)),
        *(F.max(F.when(F.col("confirmed") & (F.col("whole") == k), F.col("probability"))).alias(f"p{int(k)}") for k in (False, True)),
    )
    alone = F.size("f0") > 0
    return each.select("doc_id", "paragraph", F.when(alone, F.col("f0")).otherwise(F.col("f1")).alias("families"), F.when(alone, F.col("p0")).otherwise(F.col("p1")).alias("probability"))


def op5_licences(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its confirmed families, how many paragraphs carry
    them, how many more have a licence's words, and the best probability."""
    docs = c.table(spark, sf_dir, "documents")
    found = notices(docs.select("doc_id", "text"))
    sums = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"),
        F.count_if(F.size("families") > 0).alias("n_confirmed"),
        F.count_if(F.size("families") == 0).alias("n_other"),
        F.max("probability").alias("probability"),
    )
    rows = docs.select("doc_id").join(sums.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_other", F.lit(0)).alias("n_other"), "probability")


def op5_sql() -> str:
    weights, bias, floor = model()
    n = len(FAMILIES)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    w = ", ".join(f"({quote(g)}, {', '.join(map(str, v))})" for g, v in weights)
    known = ", ".join(f"({quote(f)}, {i}, {quote(p)})" for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in _pairs(t))
    size = ", ".join(f"({quote(f)}, {i}, {n}, {most})" for f, i, n, most in _sizes())
    z = [f"(s{k} + {bias[k]})" for k in range(n)]
    top = f"greatest({', '.join(z)})"
    gram = lambda k: f"list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i+{k - 1}], ' '))"
    return f"""
WITH w(gram, {", ".join(f"w{k}" for k in range(n))}) AS (VALUES {w}), known(f, t, gram) AS (VALUES {known}), size(f, t, pairs, most) AS (VALUES {size}),
d AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents),
a AS (SELECT doc_id, row_number() OVER () AS nr, string_split(text, chr(10)) AS x FROM d WHERE regexp_matches(text, '{CUE}')),
l AS (SELECT nr, doc_id, x, unnest(x) AS line, unnest(range(0, len(x))) AS i FROM a),
c AS (SELECT *, lag(i) OVER (PARTITION BY nr ORDER BY i) AS was FROM l WHERE regexp_matches(line, '{CUE}')),
h AS (SELECT *, CASE WHEN i = was + 1 OR (i = was + 2 AND regexp_matches(x[i], '[^ \t\r]')) THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT *, sum(new) OVER (PARTITION BY nr ORDER BY i) AS run FROM h),
r AS (SELECT nr, run, doc_id, min(i) AS paragraph, max(i) AS last, any_value(x) AS x FROM k GROUP BY nr, run, doc_id),
f AS (SELECT DISTINCT doc_id, paragraph, whole, line, text FROM (
  SELECT r.doc_id, paragraph, false AS whole, line, array_to_string(r.x[paragraph + 1:last + 1], chr(10)) AS text FROM k JOIN r USING (nr, run)
  UNION ALL SELECT doc_id, paragraph, true, array_to_string(x[paragraph + 1:last + 1], chr(10)), array_to_string(x[paragraph + 1:last + 1], chr(10)) FROM r WHERE last > paragraph)),
o AS (SELECT DISTINCT line, regexp_extract_all(line, '[a-z0-9]+') AS words FROM f),
e AS (SELECT line, unnest(list_distinct({gram(1)} || {gram(2)} || {gram(3)})) AS gram FROM o),
s AS (SELECT line, {", ".join(f"coalesce(sum(w{k}), 0) AS s{k}" for k in range(n))} FROM e LEFT JOIN w USING (gram) GROUP BY line),
g AS (SELECT line, CASE {" ".join(f"WHEN {v} = {top} THEN '{FAMILIES[k]}'" for k, v in enumerate(z))} END AS guess,
  round(1 / ({" + ".join(f"exp(({v} - {top}) / 1000.0::DOUBLE)" for v in z)}), 6) AS probability FROM s),
p AS (SELECT line, len(q) AS own, unnest(q) AS gram FROM (SELECT line, list_distinct({gram(2)}) AS q FROM o)),
m AS (SELECT line, f AS guess, max(n * 1000 // pairs) AS overlap FROM (SELECT line, own, f, t, count(*) AS n FROM p JOIN known USING (gram) GROUP BY ALL) JOIN size USING (f, t) WHERE own <= most GROUP BY ALL),
j AS (SELECT line, guess, probability, probability >= {floor} AND guess <> 'unknown' AND coalesce(overlap, 0) >= {OVERLAP} AS ok FROM g LEFT JOIN m USING (line, guess)),
u AS (SELECT doc_id, paragraph, text, list(DISTINCT guess) FILTER (ok AND NOT whole) AS f0, list(DISTINCT guess) FILTER (ok AND whole) AS f1,
  max(probability) FILTER (ok AND NOT whole) AS p0, max(probability) FILTER (ok AND whole) AS p1 FROM f JOIN j USING (line) GROUP BY ALL),
v AS (SELECT doc_id, coalesce(f0, f1, []) AS fs, CASE WHEN f0 IS NOT NULL THEN p0 ELSE p1 END AS probability FROM u),
y AS (SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(fs)))), ',') AS families, count(*) FILTER (len(fs) > 0) AS n_confirmed,
  count(*) FILTER (len(fs) = 0) AS n_other, max(probability) AS probability FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(families, '') AS families, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_other, 0) AS n_other, probability
FROM d LEFT JOIN y ON d.doc_id IS NOT DISTINCT FROM y.doc_id
"""

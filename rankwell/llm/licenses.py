"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Words are the runs of a-z and 0-9 of the lower-cased text. Templates fall in classes by their number of shingles, a
class's stride S being the power of two from there up; windows of 2 S shingles start at every S-th, so any run of S
shingles lies whole in one. If a window holds 80 % of a template, their Jaccard similarity is at least
0.8 (S/2) / (2 S + 0.1 S) = 0.19, and one of 64 single-row bands collides with probability over 1 - 0.81^64 > 0.999998.
A band can only collide by a shingle that a template has, so windows without one need no signature: while the templates
have up to MAX_SHINGLES distinct shingles, texts and windows without any of them are left out first, which loses nothing.
With more templates every window gets a signature and the bands alone retrieve.

Defined results: null and empty texts match nothing; a text or template with fewer words than a shingle has its whole
word sequence as the one shingle (none if wordless); a document that matches a template in several windows gets one
row, of its best containment and the first window that has it; rows equal in id and text count once; texts and words of
any length are read whole; an empty table or no template gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut, join_small

SHINGLE, BANDS, LEAST = 5, 64, 0.8
#: Distinct template shingles up to which their hashes stand in the plan, as a filter before the bands.
MAX_SHINGLES = 20_000

#: Notices of public licenses, fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
        "domain worldwide. This software is distributed without any warranty."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def words(text: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-cased text; none for null."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingle_hashes(w: Column, n: int = SHINGLE) -> Column:
    """A 64-bit hash of each shingle, in order, repeats included. `w` should be a plain column: it is read n times a shingle."""
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(n)))))
    return F.when(F.size(w) < n, whole).otherwise(each)


def _alone(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimizer won't copy into every place that reads it."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def signature(hashes: Column, bands: int = BANDS) -> Column:
    """MinHash: for each band the least hash of the shingles under the band's own hash function."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def template_table(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Rows (license, stride, hashes): the distinct shingle hashes of each template with a word."""
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, text string")
    t = _alone(_alone(rows, "w", words(F.col("text"))), "hashes", F.array_distinct(shingle_hashes(F.col("w"))))
    return t.filter("size(hashes) > 0").select("license", F.pow(2, F.ceil(F.log2(F.size("hashes")))).cast("int").alias("stride"), "hashes")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, license, containment, first_word) of the documents that hold at least 80 % of a template's shingles."""
    t = cut(template_table(docs, templates))
    strides = F.array(*[F.lit(r[0]) for r in t.select("stride").distinct().orderBy("stride").collect()]).cast("array<int>")  # powers of two
    known = [r[0] for r in t.select(F.explode("hashes")).distinct().limit(MAX_SHINGLES + 1).collect()]
    few = len(known) <= MAX_SHINGLES
    ours = F.array(*map(F.lit, known if few else [])).cast("array<bigint>")

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = _alone(d, "w", words(F.col("text"))).select("id", F.xxhash64("text").alias("key"), "w")
    d = _alone(d, "hs", shingle_hashes(F.col("w"))).select("id", "key", "hs").filter(F.arrays_overlap("hs", ours) if few else F.size("hs") > 0)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("hs") - 1, F.lit(0)), F.col("stride")), lambda i: F.struct(i.alias("start"), F.slice(F.col("hs"), i + 1, F.col("stride") * 2).alias("win")))
    w = d.withColumn("stride", F.explode(strides)).select("id", "key", "stride", F.explode(starts).alias("s")).select("id", "key", "stride", "s.start", "s.win")
    w = (w.filter(F.arrays_overlap("win", ours)) if few else w).withColumn("win", F.array_distinct("win"))
    bands = w.select("id", "key", "stride", "start", "win", F.posexplode(signature(F.col("win"))).alias("band", "least"))
    index = t.select("license", "stride", "hashes", F.posexplode(signature(F.col("hashes"))).alias("band", "least"))
    found = join_small(bands, index, ["stride", "band", "least"], "inner", F.size("hashes") * 8 + F.length("license") * 4)
    share = F.size(F.array_intersect("hashes", "win")) / F.size("hashes")
    found = found.withColumn("containment", share).filter(F.col("containment") >= LEAST)
    best = found.groupBy("id", "key", "license").agg(F.max(F.struct("containment", -F.col("start"))).alias("m"))
    return best.select(F.col("id").alias(id_col), "license", F.col("m.containment").alias("containment"), (-F.col("m.col2")).cast("int").alias("first_word"))


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """That at least one band of one row collides."""
    return 1 - math.pow(1 - similarity, bands)

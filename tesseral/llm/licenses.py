"""License scan by MinHash bands over text windows; DataFrame operations only.

Texts and templates become hashes of five-word shingles (letters and digits,
lower case). Templates are put in classes by length, and a text is cut into
overlapping windows of a size that fits the class. A window retrieves the templates
with which it shares a MinHash band; exact containment of the template's shingles
in the window decides.

With containment c and a window of at most 2m shingles for templates of more than
m / 2 to m, the Jaccard similarity is at least c * t / (2m + (1 - c) * t), with t the
template's shingles: 0.176 for c = 0.75 and the shortest template of a class. With
bands of one value each, 32 bands miss with probability (1 - 0.176)^32 = 0.002 at
most, and several windows cover each passage.

Before windows are made, a lossless test drops texts, and then windows, that have
no shingle of any template: their containment is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: License texts where they are short, else the usual notices of the
#: license, and phrases by which texts name it. Relatives share much of their text: a
#: notice of the GPL 2, LGPL or AGPL also has 0.75 and more of that of the GPL 3, and texts
#: of the two BSD licenses of each other's; the best containment tells.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Free Software Foundation; either version 2 of the License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL", "under the terms of the GNU Affero General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("BSD-2-Clause", 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def word_shingles(text: Column, size: int = 5) -> Column:
    """Hashes of the word shingles of a text, in order; empty for fewer words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slide = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(size))))
    return _bound(words, lambda ws: F.when(F.size(ws) < size, F.array().cast("array<bigint>")).otherwise(slide(ws)))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda the optimizer
    would else compute it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def template_table(spark, notices=NOTICES, size: int = 5) -> DataFrame:
    """(license, form, shingles, klass): the distinct shingles of each template and
    its class, the smallest power of two that is no less than their number."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(i).alias("form"), F.lit(t).alias("notice")) for i, (n, t) in enumerate(notices))))
    t = spark.range(1).select(rows.alias("r")).select("r.*").withColumn("shingles", F.array_distinct(word_shingles(F.col("notice"), size)))
    return t.filter(F.size("shingles") > 0).select("license", "form", "shingles", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles").cast("double")))).cast("int").alias("klass"))


def _bands(shingles: Column, bands: int) -> Column:
    """The least hash of the shingles for each band."""
    return _bound(shingles, lambda x: F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda s: F.array_min(F.transform(x, lambda h: F.xxhash64(h, s)))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, containment: float = 0.75, bands: int = 32, size: int = 5, block: int = 200) -> DataFrame:
    """One row for each document and license found: the id, ``license``,
    ``containment`` (the best) and ``first_shingle`` (where the earliest window with
    it begins, in words). Null, empty and short texts give no row, nor does an empty
    table; a template under ``size`` words has no shingle and is never found. Repeated rows with
    one id count as one document. A task holds one text's shingles, and the windows of a
    segment of it. Templates go in blocks of ``block``, so what is
    broadcast, and what the plan holds, is bounded."""
    out = None
    for a in range(0, len(notices), block):
        part = _scan_block(docs, id_col, text_col, notices[a : a + block], containment, bands, size)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("containment", -F.col("first_shingle"))).alias("b")
    return out.groupBy(id_col, "license").agg(best).select(id_col, "license", F.col("b.containment").alias("containment"), (-F.col("b.col2")).alias("first_shingle"))


def _scan_block(docs, id_col, text_col, notices, containment, bands, size, segment: int = 1 << 15) -> DataFrame:
    templates = template_table(docs.sparkSession, notices, size)
    known = [(r.klass, r.shingles) for r in templates.select("klass", "shingles").collect()]  # the block's templates
    classes = sorted({k for k, _ in known})
    known_shingles = sorted({h for _, s in known for h in s})
    known_set = F.array(*(F.lit(h) for h in known_shingles)) if known_shingles else F.array().cast("array<bigint>")
    texts = docs.select(F.col(id_col), F.coalesce(word_shingles(F.col(text_col), size), F.array().cast("array<bigint>")).alias("__s")).filter(F.arrays_overlap("__s", known_set))
    if not classes:
        return texts.select(id_col, F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_shingle")).filter("false")
    # Long texts go on in segments, which overlap by the largest window; each window begins in one.
    reach = 2 * classes[-1]
    segments = F.transform(F.sequence(F.lit(0), F.size("__s") - 1, F.lit(segment)), lambda a: F.struct(a.cast("int").alias("at"), F.slice("__s", a.cast("int") + 1, F.lit(segment + reach)).alias("s")))
    rows = texts.select(id_col, F.explode(segments).alias("__g")).select(id_col, F.col("__g.at").alias("__at"), F.col("__g.s").alias("__s"))
    place = lambda h, i: F.when(h.isin(*known_shingles), i)
    rows = rows.withColumn("__h", F.filter(F.transform("__s", place), lambda i: i.isNotNull()))
    # Windows of all classes that hold a template's shingle, as (class, start, distinct shingles).
    def cut(both) -> Column:
        shingles, hits = both["s"], both["h"]

        def of(k: int) -> Column:
            step = max(1, k // 2)
            low = lambda p: F.greatest(F.lit(0), F.ceil((p - 2 * k + 1) / step)).cast("int")
            high = lambda p: F.floor(p / step).cast("int")
            starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.when(low(p) <= high(p), F.transform(F.sequence(low(p), high(p)), lambda j: j * step)).otherwise(F.array().cast("array<int>")))))
            window = lambda i: F.array_distinct(F.slice(shingles, i + 1, F.lit(2 * k)))
            return F.transform(F.filter(starts, lambda i: i < segment), lambda i: F.struct(F.lit(k).alias("klass"), i.alias("start"), window(i).alias("window")))

        return F.flatten(F.array(*(of(k) for k in classes)))

    found = _bound(F.struct(F.col("__s").alias("s"), F.col("__h").alias("h")), cut)
    windows = rows.filter(F.size("__h") > 0).select(id_col, "__at", F.explode(found).alias("w")).select(id_col, "w.klass", (F.col("__at") + F.col("w.start")).alias("start"), "w.window")
    keyed = windows.select("*", F.posexplode(_bands(F.col("window"), bands)).alias("band", "value"))
    keys = templates.select("license", "form", "shingles", "klass", F.posexplode(_bands(F.col("shingles"), bands)).alias("band", "value"))
    hits = keyed.join(F.broadcast(keys), ["klass", "band", "value"])  # at most block * bands rows of short arrays
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    return hits.select(id_col, "license", "start", share.alias("containment")).filter(F.col("containment") >= containment).select(id_col, "license", "containment", F.col("start").alias("first_shingle"))

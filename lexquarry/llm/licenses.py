"""License scans: MinHash bands over overlapping windows find templates, exact containment decides.

Everything is Spark expressions over one row a document; only windows that share a band with a template are
exploded and verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of one MinHash value each. A window that holds a template has at least THRESHOLD of its shingles among at
#: most 2 * block_of(m): with m over half a block that is a similarity of 0.4 / 2.1 or more, and the chance of a
#: shared band 1 - (1 - 0.19)**64 > 0.99999.
BANDS = 64

#: Whole texts of short licences, headers and notices of long ones, and usual short forms, by SPDX name.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_CC = "This work is licensed under a Creative Commons {} International License."
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0-header": _GPL.format("Affero General Public License", "3") + " " + _GPL_END.format("Affero General Public License"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": _CC.format("Attribution 4.0"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": _CC.format("Attribution-NonCommercial 4.0"),
    "CC-BY-NC-SA-4.0": _CC.format("Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": _GPL.format("General Public License", "2").replace("This program is free software: you", "This program is free software; you"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GPL.format("General Public License", "3") + " " + _GPL_END.format("General Public License"),
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "LGPL-3.0-header": _GPL.format("Lesser General Public License", "3").replace("This program", "This library"),
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-short": "Licensed under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license_id string, text string")


def words(text: Column) -> Column:
    """Runs of letters and digits in small letters. Null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; a shorter text, if not empty, is one shingle."""
    n = F.size(tokens)
    run = lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(SHINGLE)])
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), run)).when(n > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))


def _seeds() -> Column:
    # hashes are uniform, so exclusive-or with a constant is another order of them
    seeds = [(0x9E3779B97F4A7C15 * (band + 1)) & ((1 << 64) - 1) for band in range(BANDS)]
    return F.array(*[F.lit(s - (1 << 64) if s >> 63 else s).cast("long") for s in seeds])


def signature(hashes: str) -> Column:
    """The MinHash values of a column with a set of hashes, a band each."""
    return F.transform(_seeds(), lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def winners(sig: str) -> Column:
    """The hashes that a signature's values are of."""
    return F.array_distinct(F.zip_with(sig, _seeds(), lambda v, s: v.bitwiseXOR(s)))


def block_of(m: int) -> int:
    """Shingles of a block for a template of m shingles: the smallest power of two that is not below m."""
    return 1 << max(0, math.ceil(math.log2(max(1, m))))


def _places(hashes: Column, level: int, values: list[int]) -> Column:
    """The windows, as (level, number), that hold one of the values."""
    at = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(values), F.floor(i / level).cast("int"))), lambda i: i.isNotNull())
    both = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i - 1))))
    return F.transform(F.filter(both, lambda i: i >= 0), lambda i: F.struct(F.lit(level).alias("level"), i.alias("i")))


def scan_licenses(docs: DataFrame, templates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, containment, n_windows: of every template of which a window of the document holds at least
    threshold of the different shingles; the best containment, and the number of such windows.

    Windows are two neighbouring blocks and overlap by one, so every run as long as a template lies in one. A window
    can share a band with a template only if it holds the shingle that is the template's value there: signatures are
    made for the windows that hold such a shingle, which loses none. Null and empty texts have no rows; rows that
    share an id are one document. Templates are a bounded list (their values become literals); those without words
    match nothing.
    """
    # words and shingles are columns of their own: inside a lambda they would be made again for every element
    known = templates.select("license_id", words(F.col("text")).alias("w")).select("license_id", shingles(F.col("w")).alias("s")).where("size(s) > 0").select("license_id", F.array_distinct("s").alias("s"), signature("s").alias("sig")).select("*", winners("sig").alias("values")).collect()
    own = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_t")).select("_id", shingles(F.col("_t")).alias("_s"))
    empty = own.select(F.col("_id").alias(id_col), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows")).where(F.lit(False))
    if not known:
        return empty
    levels = sorted({block_of(len(k.s)) for k in known})
    # (level, window) of every place where a value of a band of a template of that level is
    places = []
    for level in levels:
        values = sorted({v for k in known if block_of(len(k.s)) == level for v in k["values"]})
        places.append(_places(F.col("_s"), level, values))
    # explode_outer: a filter on the arrays would be pushed down to the text and make them again inside the lambdas
    windows = own.select("_id", "_s", F.concat(*places).alias("_places")).select("_id", "_s", F.explode_outer("_places").alias("_w")).where("_w is not null")
    windows = windows.select("_id", F.col("_w.level").alias("_level"), F.array_distinct(F.slice("_s", F.col("_w.i") * F.col("_w.level") + 1, F.col("_w.level") * 2)).alias("_set"))
    windows = windows.withColumn("_min", signature("_set"))
    table = docs.sparkSession.createDataFrame([(block_of(len(k.s)), k.license_id, list(k.s), list(k.sig)) for k in known], "t_level int, license_id string, t array<bigint>, sig array<bigint>")
    retrieved = (F.col("_level") == F.col("t_level")) & F.exists(F.zip_with("_min", "sig", lambda a, b: a == b), lambda x: x)
    pairs = windows.join(F.broadcast(table), retrieved)  # the bounded list of templates
    hits = pairs.select("_id", "license_id", (F.size(F.array_intersect("t", "_set")) / F.size("t")).alias("containment")).where(F.col("containment") >= threshold)
    return hits.groupBy(F.col("_id").alias(id_col), "license_id").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))

"""Licence scan by diagonal voting; DataFrame functions only.

All rolling word k-grams of a document are hashed and joined to their places in the templates (pairs for
phrases and short notices, four words for full texts); the join also compares the words.  A match votes for
the diagonal (document place minus template place).  Neighbouring diagonals of one template merge: around
each diagonal a band of ``DRIFT`` to either side counts as one span, so that a few inserted or lost words do
not split it and no span drifts further.  A span is then verified: of each template place only the first
match in the band counts, and only if it stands behind those of all places before it.  A notice or text is
found where enough of its places are verified so and no overlapping one stands above it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, UPPER, WORD, words_of

# The phrases of the contract, and short well-known licence notices, with their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
]
# Identifiers of machine-readable licence lines, with their labels.
IDENTIFIERS = [
    ("agpl", "agpl 3 0"), ("apache", "apache 2 0"), ("boost", "bsl 1 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("cc0", "cc0 1 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"),
    ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl", "mpl 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
]
NOTICES += [(label, f"spdx license identifier {name}") for label, name in IDENTIFIERS]

# Standard licence texts and the standard notices of long licences, as published.
_BSD_TWO = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
    3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """
    This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
    This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
    You should have received a copy of the GNU {name} along with this {what}."""
TEXTS = [
    ("agpl", _GNU.format(what="program", name="Affero General Public License", version="3")),
    ("apache", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("boost", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("bsd-2-clause", _BSD_TWO + _BSD_END),
    ("bsd-3-clause", _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("gpl", _GNU.format(what="program", name="General Public License", version="3")),
    ("gpl", _GNU.format(what="program", name="General Public License", version="2")),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("lgpl", _GNU.format(what="library", name="Lesser General Public License", version="3")),
    ("lgpl", _GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
]
#: Words of a k-gram: of phrases and notices, and of full texts.
SHORT, LONG = 2, 4
#: Diagonals at most this far from a span's own merge into it; share of a notice's places that must be verified.
DRIFT, COVER = 3, 0.8


def listed(phrases=PHRASES, notices=NOTICES, texts=TEXTS) -> list[tuple[int, str, bool, int, str]]:
    """(template, label, whether a phrase, words of its k-grams, words) in order; a text of too few words counts as a notice."""
    plain = lambda text: " ".join(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))))
    known = [(label, True, SHORT, plain(t)) for label, t in phrases] + [(label, False, SHORT, plain(t)) for label, t in notices]
    known += [(label, False, LONG if len(plain(t).split()) >= LONG else SHORT, plain(t)) for label, t in texts]
    return [(i, *row) for i, row in enumerate(known)]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, texts=TEXTS) -> DataFrame:
    """(template, label, base, k, pairs, place, gram, hash): one row for each k-gram of each template, ``pairs`` their number; some two thousand rows."""
    words = spark.createDataFrame(listed(phrases, notices, texts), "template int, label string, base boolean, k int, text string").withColumn("w", F.split("text", " "))
    each = words.withColumn("pairs", F.size("w") - F.col("k") + 1).select("template", "label", "base", "k", "pairs", "w", F.explode(F.sequence(F.lit(0), F.col("pairs") - 1)).alias("place"))
    rows = each.select("template", "label", "base", "k", "pairs", "place", F.slice("w", F.col("place") + 1, F.col("k")).alias("gram"))
    pair = lambda i: F.xxhash64(F.get("gram", F.lit(i)), F.get("gram", F.lit(i + 1)))
    return rows.withColumn("hash", F.when(F.col("k") == SHORT, pair(0)).otherwise(F.xxhash64(pair(0), pair(2))))


def _pair_hashes(words: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, hashed).otherwise(F.array().cast("array<long>"))


def _long_hashes(pairs: Column) -> Column:
    """Hashes of four words, from those of the pairs at their places."""
    n = F.greatest(F.size(pairs) - 2, F.lit(0))
    return F.zip_with(F.slice(pairs, F.lit(1), n), F.slice(pairs, F.lit(3), n), lambda a, b: F.xxhash64(a, b))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, texts=TEXTS) -> DataFrame:
    """One row per document with its licence phrases, notices and full texts.

    Columns: doc_id, n_words, n_base (places of all phrases), first_word, last_word (smallest and
    largest start of a phrase, from 0; null if none), base_labels, labels (distinct, sorted, joined by
    commas), score (the largest share of a template's places in what was found, 0 to 1; 0 if nothing),
    spans (array of struct(label, start, end, share) of what was found).

    Where notices or texts overlap, a text stays before a notice, then that with the larger share, then the
    longer, the one listed first, the earlier; phrases all count. Null and empty texts have no words and score 0. Repeated rows and
    null doc_ids get a row each; an empty table gives no rows; other columns are not read.
    """
    known = templates(docs.sparkSession, phrases, notices, texts)
    sentinel = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(True).alias("base"), F.lit(SHORT).alias("k"), F.lit(1).alias("pairs"), F.lit(0).alias("place"), F.array().cast("array<string>").alias("gram"), F.lit(0).cast("long").alias("hash"))
    known = F.broadcast(known.unionByName(sentinel))  # some two thousand rows, from constants
    reach = max(len(words.split(" ")) for *_, words in listed(phrases, notices, texts)) + 2 * DRIFT
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    hashed = rows.withColumn("h", _pair_hashes(F.col("w")))
    # Place 0 is the document's own row, then come its pairs, then its runs of four words.
    grams = hashed.select("row", "doc_id", "n_words", "w", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("h"), _long_hashes(F.col("h")))).alias("at", "gram_hash"))
    n_pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    size, spot = F.when(F.col("at") > n_pairs, LONG).otherwise(SHORT), F.col("at") - 1 - F.when(F.col("at") > n_pairs, n_pairs).otherwise(0)
    same = (F.col("template") < 0) | ((F.col("k") == size) & (F.slice("w", F.greatest(spot + 1, F.lit(1)), F.col("k")) == F.col("gram")))
    key, span = ["row", "doc_id", "n_words"], ["template", "label", "base", "k", "pairs"]
    votes = grams.join(known, (F.col("gram_hash") == F.col("hash")) & same).select(*key, *span, "place", spot.alias("spot"))
    # A phrase must be whole, on one diagonal; a vote for a notice counts in all bands that hold its diagonal. All that follows stays in one row's partition.
    band = F.when(F.col("base"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)))
    banded = votes.repartition("row").select("*", F.explode(band).alias("shift")).withColumn("diagonal", F.col("spot") - F.col("place") + F.col("shift"))
    first = banded.groupBy(*key, *span, "diagonal", "place").agg(F.min("spot").alias("spot"))
    before = Window.partitionBy(*key, *span, "diagonal").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ordered = first.withColumn("fits", F.col("spot") > F.coalesce(F.max("spot").over(before), F.lit(-2)))
    verified = ordered.where("fits").groupBy(*key, *span, "diagonal").agg(F.count("*").alias("matched"), F.min("spot").alias("start"), (F.max("spot") + F.first("k")).alias("end"))
    share = F.round(F.col("matched") / F.col("pairs"), 6)
    found = F.when(F.col("template") < 0, True).when(F.col("base"), F.col("matched") == F.col("pairs")).otherwise(share >= COVER)
    best = verified.where(found).groupBy(*key, *span, "start").agg(F.max(F.struct("matched", -F.col("end"))).alias("m")).select(*key, *span, "start", F.col("m.matched").alias("matched"), (-F.col("m.col2")).alias("end"))
    rank = F.struct((F.col("k") > SHORT).alias("whole"), share.alias("share"), "pairs", (-F.col("template")).alias("template"), (-F.col("start")).alias("start"))
    near = Window.partitionBy(*key).orderBy("start").rangeBetween(-reach, reach)
    notice = ~F.col("base")
    rivals = best.withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(share)).withColumn("rank", rank).withColumn("rivals", F.collect_list(F.when(notice, F.struct("start", "end", "rank"))).over(near))
    beaten = F.exists("rivals", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"]) & (o["rank"] > F.col("rank")))
    place, real = F.col("base") & (F.col("template") >= 0), F.col("template") >= 0
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (
        rivals.where(~(notice & beaten))
        .groupBy(*key)
        .agg(
            F.count(F.when(place, 1)).alias("n_base"),
            F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
            joined(place).alias("base_labels"),
            joined(real).alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.when(real, F.struct("label", "start", "end", "share")))).alias("spans"),
        )
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )

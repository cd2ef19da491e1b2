"""Licence scans by canonical digest lookup, in Spark SQL expressions only.

A text is brought to a canonical form in which what licences may differ in no longer
shows: letter case, copyright lines, punctuation, white space and equivalent spellings.
The digest of the whole canonical text is then hash-joined to the digests of known
licence texts.  One-line notices ("Released under the MIT License.") are known texts too
and are looked up for each line of a document that begins as one of them does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.common import fresh, small_side

# Equivalent spellings of the SPDX matching guidelines (whole words).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("per cent", "percent"),
)

# Public licence texts, without their copyright lines.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""{_MIT_GRANT}
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_MIT_WARRANTY}"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
LICENCES = {
    "MIT": _MIT,
    "MIT-0": _MIT_GRANT.replace(", subject to the following conditions:", ".") + "\n" + _MIT_WARRANTY,
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD}\n{_BSD_NAMES}\n{_BSD_WARRANTY}",
    "Zlib": _ZLIB,
    "Unlicense": _UNLICENSE,
}
#: Canonical digests of long licences, from the editions in Debian's /usr/share/common-licenses:
#: as they stand there, and without the appendix, exhibits or heading.
DIGESTS = (
    ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "Apache-2.0"),
    ("f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0", "Apache-2.0"),
    ("ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", "GPL-2.0"),
    ("a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", "GPL-2.0"),
    ("42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1", "GPL-3.0"),
    ("4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", "GPL-3.0"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0"),
    ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "MPL-2.0"),
    ("075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de", "MPL-2.0"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32", "CC0-1.0"),
)
#: Titles that may stand above a licence.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "MIT/Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
}
#: Names that notices use.
NAMES = {
    "MIT": ("MIT License", "MIT Licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "Unlicense": ("Unlicense",),
}
PHRASES = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This file is licensed under the {}.", "Distributed under the {}.", "SPDX-License-Identifier: {}")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a line is about that begins with "copyright" and is part of a licence, and what only
#: copyright lines hold: years and their blanks, signs, and who has it.
_LICENCE_TALK = "and|disclaimer|holders?|in|interests?|laws?|licen[cs]es?|notices?|or|owners?|permission|protection|statements?|treaty"
_OWNERS = r"\b(?:19|20)[0-9][0-9]\b|\(c\)|©|<year>|\[yyyy\]|\[year\]|\{yyyy\}|\{year\}|\b(?:authors?|by|contributors?|corporation|foundation|inc|ltd)\b"
#: Lines that a licence may have or lack, in lower case.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;%!-]*(?:(?:portions )?copyright\b(?![ \t]+(?:" + _LICENCE_TALK + r")\b)(?=[^\n]*(?:" + _OWNERS + r"))[^\n]*"
    r"|\(c\)[^\n]*\b(?:19|20)[0-9][0-9]\b[^\n]*|©[^\n]*|all rights reserved[ \t.]*)$"
)


def _alternatives(words: list[str]) -> str:
    """A pattern of words that looks at each first letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ")"


ANY_SPELLING = r"\b" + _alternatives([a for a, _ in SPELLINGS]) + r"\b"


def _notice_starts() -> str:
    """How the lines that may be notices begin: the phrases up to the name, in all spellings
    and with any punctuation."""
    out = []
    for phrase in PHRASES:
        words = re.findall("[a-z]+", phrase.partition("{")[0].lower())
        out.append(r"[^\p{L}\p{N}\n]+".join(_alternatives([w, *(a for a, b in SPELLINGS if b == w)]) for w in words))
    return r"^[^\p{L}\p{N}\n]*(?:" + "|".join(out) + r")\b"


NOTICE_START = _notice_starts()


def spelled(canon: Column) -> Column:
    """A canonical text with one of each pair of equivalent spellings."""
    out = canon
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.when(canon.rlike(ANY_SPELLING), out).otherwise(canon)


def canonical(text: Column) -> Column:
    """Lower case on one line, without copyright lines and punctuation, in one of equivalent
    spellings.  Letters and digits of all scripts are kept."""
    x = F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), COPYRIGHT_LINE, "")
    return spelled(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))


def known(spark: SparkSession, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, license) of whole licence texts, and of one-line notices; some hundred rows,
    whatever the input, and those of ``more`` (license, text)."""
    texts = [(k, t) for k, v in LICENCES.items() for u in (v, v.replace("http://", "https://")) for t in (u, *(f"{title}\n{u}" for title in TITLES[k]))]
    notices = [(k, p.format(n)) for k, names in NAMES.items() for n in (*names, k) for p in PHRASES]
    out = []
    for rows in (texts, notices):
        df = spark.createDataFrame(rows, "license string, text string")
        if more is not None and rows is texts:
            df = df.union(more.where("text is not null and license is not null").select("license", "text"))
        out.append(df.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license")))
    long = spark.createDataFrame(DIGESTS, "digest string, license string").join(out[0], "digest", "left_anti")
    return out[0].union(long), out[1]


def scan_licenses(df: DataFrame, text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``df`` with ``digest`` (of the canonical text; null if nothing is left of it),
    ``license`` (what the whole text is; else null) and ``notices`` (sorted ids that lines
    of it name).

    ``more`` (license, text) adds whole texts to the known ones; a digest that two licences
    share goes to the id that sorts first.  Null and empty texts match nothing.  Repeated
    rows give repeated results; an empty table stays empty.  Columns of these names are
    replaced, all others stay.
    """
    spark = df.sparkSession
    texts, notices = known(spark, more)
    lines = {r["digest"]: r["license"] for r in notices.collect()}
    table = F.create_map(*(F.lit(x) for kv in sorted(lines.items()) for x in kv))
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.drop("digest", "license", "notices")
    # only lines that begin as a known notice does are brought to canonical form and digested
    low = F.translate(text, UPPER, UPPER.lower())
    named = F.filter(F.split(low, "\n", -1), lambda x: x.rlike(NOTICE_START))
    hits = F.transform(named, lambda x: F.try_element_at(table, F.sha2(canonical(x), 256)))
    found = F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))
    found = F.when(low.rlike("(?m)" + NOTICE_START), found).otherwise(F.expr("cast(array() as array<string>)"))
    (whole,) = fresh([*src.columns, "digest", "license", "notices"], "whole")
    out = src.withColumn(whole, canonical(text)).withColumns({"digest": F.when(F.col(whole) != "", F.sha2(whole, 256)), "notices": found}).drop(whole)
    return out.join(small_side(texts), "digest", "left")

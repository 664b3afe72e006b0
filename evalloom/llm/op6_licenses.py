"""License scans: canonical digest lookup.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its
SHA-256 digest is hash-joined with the digests of known licence texts, normalised the same way.  All
of it is built-in column functions.  The known table may have any size: both lookups are equi-joins on the
digest, and the engine broadcasts a side only where its own size estimate allows it.

Besides whole texts, a line that names a licence is looked up the same way among the usual notices.
Null or empty texts, and texts without letters or digits, have no digest and no licence.  Repeated
rows and ties stand alone: every row gets its own result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import id_text, table

# Spellings that count as equal, applied in this order after lower-casing.
SPELLINGS = [
    ("https://", "http://"),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("&", " and "),
]
#: A line that only states who holds the copyright.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*)?((\(c\)|©)[^\n]*|copyright[ \t]+[<\[{]?(year|yyyy|[0-9]{4})[^\n]*|all rights reserved[ \t.]*)"
NOTICE = "licen[cs]e"
BLANKS = r"[ \t\n\r\f]+"

# Known licence texts.
_PERMIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
LICENSES = {
    "MIT": _MIT + _PERMIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}
# Names as notices give them, and how notices begin.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
STARTS = ["Licensed under", "Licensed under the", "Released under", "Released under the", "This work is licensed under", "This work is licensed under the", "This software is licensed under the", "Distributed under the"]


TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License"}
# SHA-256 of the canonical form of whole licence texts too long to be quoted here, as their stewards publish them.
DIGESTS = {
    "Apache-2.0": "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c",
    "Artistic-1.0-Perl": "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd",
    "GFDL-1.3": "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd",
    "GPL-1.0": "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8",
    "LGPL-2.0": "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
    "LGPL-2.1": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}


def known_texts() -> list[tuple[str, str]]:
    notices = [(i, f"{start} {name}") for i, names in NAMES.items() for name in names for start in STARTS]
    return [*LICENSES.items(), *((i, f"{title}\n{LICENSES[i]}") for i, title in TITLES.items()), *notices]


def normalise(text: Column) -> Column:
    """Canonical form of a licence text."""
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights")
    out = F.when(marked, F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low)
    out = F.regexp_replace(out, BLANKS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where nothing is left."""
    norm = normalise(text)
    return F.when(norm != "", F.sha2(norm, 256))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id of known texts (default: all of this module); of equal digests the first identifier by name."""
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_norm (length of the canonical form), digest, license_id, notices of every row.

    ``licences``: digest, license_id, of any size.  ``notices`` lists the licences that lines of the text
    name, sorted and joined by a comma; empty if none.  Lines are joined by digest, too; what they name is
    brought back to the row by identifier and text.
    """
    src = id_text(df, id_col, text_col).withColumn("key", F.sha2("text", 256))
    lines = src.where(F.lower("text").rlike(NOTICE)).select("doc_id", "key", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    named = lines.where(F.lower("line").rlike(NOTICE)).select("doc_id", "key", digest(F.col("line")).alias("digest")).where("digest is not null")
    named = named.join(licences.withColumnRenamed("license_id", "named"), "digest").groupBy("doc_id", "key").agg(F.array_join(F.array_sort(F.collect_set("named")), ",").alias("notices"))
    named = named.select(F.col("doc_id").alias("n_doc"), F.col("key").alias("n_key"), "notices")
    norm = src.select("doc_id", "key", normalise(F.col("text")).alias("norm"))
    rows = norm.select("doc_id", "key", F.coalesce(F.length("norm"), F.lit(0)).cast("long").alias("n_norm"), F.when(F.col("norm") != "", F.sha2("norm", 256)).alias("digest"))
    whole = rows.join(licences.select("digest", "license_id"), "digest", "left")
    both = whole.join(named, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("key") == F.col("n_key")), "left")
    return both.select("doc_id", "n_norm", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known(spark))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def norm(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"regexp_replace({out}, {quote(BLANKS)}, ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ",\n".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())
    fixed = ",\n".join(f"({quote(i)}, {quote(d)})" for i, d in DIGESTS.items())
    return f"""
    with texts(license_id, text) as (values {rows}),
    digests(license_id, digest) as (values {fixed}),
    known as (select digest, min(license_id) license_id from (select license_id, sha256({norm("text")}) digest from texts union all select * from digests) k group by 1),
    d as (select doc_id, text, {norm("text")} norm from documents),
    lines as (select distinct doc_id, license_id from (select doc_id, unnest(string_split(text, chr(10))) line from d where regexp_matches(lower(text), '{NOTICE}')) l
      join known k on k.digest = sha256({norm("line")}) where regexp_matches(lower(line), '{NOTICE}')),
    named as (select doc_id, string_agg(license_id, ',' order by license_id) notices from lines group by 1)
    select d.doc_id, coalesce(length(norm), 0) n_norm, case when norm <> '' then sha256(norm) end digest, k.license_id, coalesce(n.notices, '') notices
    from d left join known k on k.digest = sha256(norm) and norm <> '' left join named n on n.doc_id = d.doc_id"""


ORACLE_SQL = _sql()

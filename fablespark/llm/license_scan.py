r"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and at full stops, question and
exclamation marks that white space or the end follows), which are normalised:
lower case, every run of other than letters, digits and dots one space, dots at
the ends cut off. A normalised sentence that is known, exactly or by one of the
patterns for sentences that hold names or years, becomes its identifier; other
sentences fall away. A sentence may be wrapped: lines in a row, with no blank
line or sentence end between them, are joined where they are a known sentence
together, the longest first; signs of comments before a line do not matter. Long
known sentences (of ``LONG_WORDS`` words or more) are also found inside others, as
where a title, a colon or an address joins several to one. The document's sequence of identifiers is then matched
against the ordered licence rules: the rules are tried in order, longer ones
first, each taking every place in the sequence where its identifiers stand one
after the other, and an identifier that no rule takes is reported as itself.

Only texts that hold one of the trigger words can hold a known sentence (each
known sentence has one, which is checked when the tables are loaded), so that
other texts are dropped by plain substring search.

Cases: null and empty texts hold nothing and, like all documents without a
known sentence, give no row; a sentence that stands several times counts each
time; repeated rows each come back; very long texts are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "released under the mit license": "mit_line",
    "licensed under the mit license": "mit_line",
    "this project is licensed under the mit license": "mit_line",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "spdx license identifier mit": "mit_line",
    "licensed under the apache license version 2.0": "apache_line",
    "licensed under the apache license version 2.0 the license": "apache_line",
    "you may not use this file except in compliance with the license": "apache_compliance",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "spdx license identifier apache 2.0": "apache_line",
    "this work is licensed under the gnu general public license version 3": "gpl3_line",
    "licensed under the gnu general public license version 3": "gpl3_line",
    "spdx license identifier gpl 3.0 only": "gpl3_line",
    "spdx license identifier gpl 3.0 or later": "gpl3_later_line",
    "spdx license identifier gpl 2.0 only": "gpl2_line",
    "spdx license identifier gpl 2.0 or later": "gpl2_later_line",
    "spdx license identifier lgpl 2.1 or later": "lgpl21_later_line",
    "spdx license identifier lgpl 3.0 or later": "lgpl3_later_line",
    "spdx license identifier agpl 3.0 or later": "agpl3_later_line",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc_liability",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib_origin",
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required": "zlib_acknowledgment",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib_altered",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2_copy",
    "distributed under the boost software license version 1.0": "boost_line",
    "spdx license identifier mpl 2.0": "mpl2_line",
    "spdx license identifier isc": "isc_line",
    "spdx license identifier zlib": "zlib_line",
    "spdx license identifier bsl 1.0": "boost_line",
    "spdx license identifier bsd 2 clause": "bsd2_line",
    "spdx license identifier bsd 3 clause": "bsd3_line",
    "licensed under cc by nc 4.0": "cc_by_nc_line",
    "licensed under cc by 4.0": "cc_by_line",
    "licensed under cc by sa 4.0": "cc_by_sa_line",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc_by_line",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cc_by_nc_line",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "cc_by_sa_line",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "all rights reserved": "all_rights",
}
# Names, identifiers and versions of the licences of the GNU family.
GNU = (("general", "gpl", ("2", "3")), ("lesser general", "lgpl", ("2.1", "3")), ("affero general", "agpl", ("3",)))


def _gnu_sentences() -> dict[str, str]:
    """The usual header of each, for a program and for a library."""
    out = {}
    for name, short, versions in GNU:
        terms = f"the gnu {name} public license"
        for version in versions:
            grant = f"free software you can redistribute it and or modify it under the terms of {terms} as published by the free software foundation either version {version} of the license or at your option any later version"
            # The header may name the software, so the grant counts without its subject too.
            for subject in ("", "this program is ", "this library is "):
                out[subject + grant] = f"{short}{version.replace('.', '')}_later_grant"
        out[f"see {terms} for more details"] = f"{short}_see"
        for subject in ("program", "library"):
            out[f"you should have received a copy of {terms} along with this {subject}"] = f"{short}_received"
            out[f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "gpl_hope"
    return out


SENTENCES |= _gnu_sentences()
# Sentences with names or years, as patterns over the whole sentence.
PATTERNS = (
    ("copyright", r"^(copyright( c)?|c) ([0-9]{4}[ 0-9]*)( .*)?$"),
    ("all_rights", r"^(copyright( c)?|c) .* all rights reserved$"),
)
# Sentences that hold several identifiers, as the usual file header of Apache has them.
_COMPLIANCE = "you may not use this file except in compliance with the license"
_COPIES = [f"you may obtain a copy of the license at {s} www.apache.org licenses license 2.0" for s in ("http", "https")]
_AS_IS = next(k for k, v in SENTENCES.items() if v == "apache_as_is")
JOINED = (
    {f"licensed under the apache license version 2.0 the license {_COMPLIANCE}": ("apache_line", "apache_compliance")}
    | {c: ("apache_copy",) for c in _COPIES}
    | {f"{c} {_AS_IS}": ("apache_copy", "apache_as_is") for c in _COPIES}
)
#: (licence, identifiers in a row), matched in this order.
RULES = (
    ("Zlib", ("zlib_as_is", "zlib_liability", "zlib_grant", "zlib_origin", "zlib_acknowledgment", "zlib_altered", "zlib_notice")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_liability")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liability")),
    ("Apache-2.0", ("apache_line", "apache_compliance", "apache_copy", "apache_as_is", "apache_see")),
    *((f"{short.upper()}-{v if '.' in v else v + '.0'}-or-later", (f"{short}{v.replace('.', '')}_later_grant", "gpl_hope", f"{short}_see", f"{short}_received")) for _, short, versions in reversed(GNU) for v in reversed(versions)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant", "isc_as_is", "isc_liability")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    *((f"{short.upper()}-{v if '.' in v else v + '.0'}-or-later", (f"{short}{v.replace('.', '')}_later_grant",)) for _, short, versions in reversed(GNU) for v in reversed(versions)),
    ("Zlib", ("zlib_grant",)),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl2_subject",)),
    ("MPL-2.0", ("mpl2_line",)),
    ("ISC", ("isc_line",)),
    ("Zlib", ("zlib_line",)),
    ("BSL-1.0", ("boost_line",)),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_line",)),
    ("Apache-2.0", ("apache_line",)),
    ("GPL-2.0-only", ("gpl2_line",)),
    ("GPL-2.0-or-later", ("gpl2_later_line",)),
    ("GPL-3.0-only", ("gpl3_line",)),
    ("GPL-3.0-or-later", ("gpl3_later_line",)),
    ("LGPL-2.1-or-later", ("lgpl21_later_line",)),
    ("LGPL-3.0-or-later", ("lgpl3_later_line",)),
    ("AGPL-3.0-or-later", ("agpl3_later_line",)),
    ("BSD-2-Clause", ("bsd2_line",)),
    ("BSD-3-Clause", ("bsd3_line",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_line",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_line",)),
    ("CC-BY-4.0", ("cc_by_line",)),
    ("Unlicense", ("unlicense_grant",)),
    ("All-Rights-Reserved", ("all_rights",)),
)
#: A copyright notice without a year runs over at most this many lines.
NOTICE_LINES = 50
TRIGGERS = ("licen", "copyright", "rights reserved", "permission", "warrant", "redistribut", "public domain", "(c)", "©", "liable", "misrepresented", "acknowledgment", "source distribution", "of the mpl")
#: Known sentences of so many words are found inside longer ones.
LONG_WORDS = 9

_untriggered = [s for s in SENTENCES if not any(t in s for t in TRIGGERS)]
if _untriggered:
    raise ValueError(f"known sentences without a trigger word: {_untriggered}")


_KNOWN = {k: (v,) for k, v in SENTENCES.items()} | JOINED
_STARTS = {" ".join(w[:n]) for w in (k.split(" ") for k in _KNOWN) for n in range(1, len(w) + 1)}
_LONG = re.compile(r"(?<!\S)(?:" + "|".join(re.escape(k) for k in sorted(_KNOWN, key=len, reverse=True) if k.count(" ") >= LONG_WORDS - 1) + r")(?!\S)")
_PATTERNS = tuple((name, re.compile(pattern)) for name, pattern in reversed(PATTERNS))
_END = re.compile(r"[.!?]+(?:[ \t\n\v\f\r]|$)")
_OTHER = re.compile(r"(?:[^\w.©]|_)+")
#: Comment words that a line can begin with; signs are no part of a normalised line.
_COMMENT = re.compile(r"^[ \t]*(?:dnl|rem)[ \t]+(?=\S)", re.M)


def _normal(sentence: str) -> str:
    return _OTHER.sub(" ", sentence).replace("©", "c").strip(" .")


def _by_pattern(sentence: str) -> tuple[str, ...]:
    # The stricter pattern comes last in the table and is tested first.
    return next(((name,) for name, pattern in _PATTERNS if pattern.search(sentence)), ())


def _run_ids(lines: list[str]) -> Iterator[str]:
    """Identifiers of the lines of one wrapped sentence, or of several that no sign ends."""
    whole = " ".join(lines)
    ends = list(accumulate(len(x) + 1 for x in lines))
    done = 0
    for hit in _LONG.finditer(whole):
        yield from _line_ids(_between(lines, ends, done, hit.start()))
        yield from _KNOWN[hit[0]]
        done = hit.end() + 1
    yield from _line_ids(_between(lines, ends, done, len(whole)))


def _between(lines: list[str], ends: list[int], start: int, stop: int) -> list[str]:
    """What the lines hold from one place of the joined text to another; each line begins where the one before ends."""
    cut = []
    for k in range(bisect_right(ends, start), len(lines)):
        begin = ends[k] - len(lines[k]) - 1
        if begin >= stop:
            break
        if part := lines[k][max(0, start - begin) : max(0, stop - begin)].strip():
            cut.append(part)
    return cut


def _line_ids(lines: list[str]) -> Iterator[str]:
    """Identifiers of lines that hold no long sentence."""
    i = 0
    while i < len(lines):
        text, found, end = lines[i], _KNOWN.get(lines[i], ()) or _by_pattern(lines[i]), i + 1
        j = i + 1
        while j < len(lines) and text in _STARTS:
            text = f"{text} {lines[j]}"
            j += 1
            if text in _KNOWN:
                found, end = _KNOWN[text], j
        if not found and lines[i].split(" ", 1)[0] in ("copyright", "c"):
            found, end = _wrapped_notice(lines, i)
        yield from found
        i = end


def _wrapped_notice(lines: list[str], i: int) -> tuple[tuple[str, ...], int]:
    """A copyright notice over several lines, none of which is known by itself."""
    text = lines[i]
    for j in range(i + 1, min(len(lines), i + NOTICE_LINES)):
        if lines[j] in _KNOWN or _by_pattern(lines[j]):
            break
        text = f"{text} {lines[j]}"
        if found := _by_pattern(text):
            return found, j + 1
    return (), i + 1


def text_ids(text: str) -> list[str]:
    """The identifiers of a lower-cased text's known sentences, in order."""
    out: list[str] = []
    run: list[str] = []
    for sentence in _END.sub("\n\n", _COMMENT.sub("", text)).split("\n"):
        line = _normal(sentence)
        if line:
            run.append(line)
        elif run:
            out += _run_ids(run)
            run = []
    out += _run_ids(run)
    return out


def with_sentence_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, lowered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([text_ids(t.as_py()) for t in b.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<string>")


def matched_licences(ids: Column) -> Column:
    """Distinct licences in the order of the rules, then identifiers that no rule takes.

    Sequences are written as ``;a;;b;``. A rule's match is replaced by ``#``,
    so that its identifiers can't be taken again.
    """
    left = F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";"))
    found = []
    for name, needed in RULES:
        row = ";" + ";;".join(needed) + ";"
        found.append(F.when(F.contains(left, F.lit(row)), F.lit(name)))
        left = F.replace(left, F.lit(row), F.lit("#"))
    rest = F.array_sort(F.array_distinct(F.filter(F.split(F.translate(left, "#", ";"), ";"), lambda x: x != "")))
    return F.array_distinct(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.transform(rest, lambda x: F.concat(F.lit("unmatched:"), x))))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of documents with a known sentence."""
    lowered = F.lower("text")
    near = F.lit(False)
    for t in TRIGGERS:
        near = near | F.contains(lowered, F.lit(t))
    found = with_sentence_ids(docs.filter(near).select("doc_id", lowered.alias("lowered"))).filter(F.size("ids") > 0)
    return found.select("doc_id", F.size("ids").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(matched_licences(F.col("ids")), ",").alias("licences"))


def _rule_sql() -> str:
    left, found = "(';' || array_to_string(ids, ';;') || ';')", []
    steps = ["s0 AS (SELECT *, " + left + " AS left0 FROM ids)"]
    for k, (name, needed) in enumerate(RULES):
        row = ";" + ";;".join(needed) + ";"
        steps.append(f"s{k + 1} AS (SELECT *, CASE WHEN contains(left{k}, '{row}') THEN '{name}' END AS f{k}, replace(left{k}, '{row}', '#') AS left{k + 1} FROM s{k})")
        found.append(f"f{k}")
    last = len(RULES)
    rest = f"list_sort(list_distinct(list_filter(string_split(replace(left{last}, '#', ';'), ';'), lambda x: x <> '')))"
    first = f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"
    # list_distinct keeps no order, so a name counts where it stands first.
    names = f"list_filter({first}, lambda x, i: list_position({first}, x) = i)"
    return ", ".join(steps) + f" SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_concat({names}, [('unmatched:' || x) FOR x IN {rest}]), ',') AS licences FROM s{last}"


def oracle_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    patterns = "".join(f" WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in reversed(PATTERNS))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT r, doc_id, unnest(string_split(regexp_replace(lower(text), '[.!?]+(\s|$)', chr(10), 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(lower(text), '[.!?]+(\s|$)', chr(10), 'g'), chr(10)), 1) AS pos FROM docs),
normal AS (SELECT r, doc_id, pos, regexp_replace(replace(regexp_replace(raw, '[^\p{{L}}\p{{N}}.©]+', ' ', 'g'), '©', 'c'), '^[ .]+|[ .]+$', '', 'g') AS s FROM cut),
named AS (SELECT r, doc_id, pos, coalesce(id, CASE{patterns} END) AS id FROM normal LEFT JOIN known ON s = sentence),
ids AS (SELECT r, doc_id, list(id ORDER BY pos) AS ids FROM named WHERE id IS NOT NULL GROUP BY r, doc_id),
{_rule_sql()}
"""

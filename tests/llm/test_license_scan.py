import re
import textwrap

import pytest

from fablespark.llm import license_scan as ls


def plain(text):
    ids = []
    for raw in re.sub(r"[.!?]+(\s|$)", "\n", (text or "").lower()).split("\n"):
        s = re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^\w.©]+|_", " ", raw).replace("©", "c"))
        s = re.sub(" +", " ", s)
        found = ls.SENTENCES.get(s)
        if found is None:
            for name, pattern in reversed(ls.PATTERNS):
                if re.search(pattern, s):
                    found = name
                    break
        if found:
            ids.append(found)
    left, licences = "".join(f";{i};" for i in ids), []
    for name, needed in ls.RULES:
        row = "".join(f";{n};" for n in needed)
        if row in left:
            licences += [name] if name not in licences else []
            left = left.replace(row, "#")
    rest = sorted({x for x in re.split("[;#]", left) if x})
    return ids, licences + [f"unmatched:{x}" for x in rest]


MIT = "Copyright (c) 2020 Some One. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
TEXTS = {
    1: MIT, 2: "words\nLicensed under the Apache License, Version 2.0.\nmore", 3: "Released under the MIT License. All rights reserved.", 4: "Licensed under CC BY-NC 4.0.", 5: "a licence is no license", 6: None, 7: "", 8: "© 2021 Firm. All Rights Reserved!", 9: "copyright law is old",
    10: "x " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "y " * 10, 11: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", 12: "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0",
}


def test_against_plain(spark):
    df = spark.createDataFrame([(k, t, "i", 1) for k, t in TEXTS.items()] + [(2, TEXTS[2], "i", 1), (None, TEXTS[4], None, None)], "doc_id long, text string, ids string, licences int")
    rows = ls.scan_licences(df).collect()
    want = {k: plain(t) for k, t in TEXTS.items() if plain(t)[0]}
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    got = {r["doc_id"]: (r["sentence_ids"].split(","), r["licences"].split(",")) for r in rows if r["doc_id"] is not None}
    assert got == want
    assert got[1][1] == ["MIT", "unmatched:copyright"] and got[10][1] == ["GPL-3.0-only"] and got[11][1] == ["unmatched:bsd_source"]
    assert ls.scan_licences(df.limit(0)).count() == 0


APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
BSD = [
    "Copyright (c) 2019, Some One",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]


def wrapped(parts, width, prefix="", between=""):
    lines = []
    for p in parts:
        lines += [prefix + x for x in textwrap.wrap(p.strip(), width)] + [prefix + between]
    return "code here\n" + "\n".join(lines) + "\nmore code"


@pytest.mark.parametrize("width", [40, 70, 80, 5000])
@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// ", "dnl "])
def test_wrapped_texts(width, prefix):
    for parts, ids in [
        (APACHE, ["apache_line", "apache_compliance", "apache_copy", "apache_as_is", "apache_see"]),
        (GPL, ["gpl3_later_grant", "gpl_hope", "gpl_see", "gpl_received"]),
        (BSD, ["copyright", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
        (MIT.replace("One. ", "One\n").split("\n"), ["copyright", "mit_grant", "mit_notice", "mit_as_is"]),
    ]:
        assert ls.text_ids(wrapped(parts, width, prefix).lower()) == ids


def test_wrapped_rows(spark):
    texts = [wrapped(APACHE, 72, "# "), " ".join(x.strip() for x in APACHE), wrapped(GPL, 72), wrapped(BSD, 72, " * "), "Copyright Some One and many\nothers, all rights reserved."]
    rows = ls.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in rows} == {0: "Apache-2.0", 1: "Apache-2.0", 2: "GPL-3.0-or-later", 3: "BSD-3-Clause,unmatched:copyright", 4: "All-Rights-Reserved"}


AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
FULL = {
    "MIT": ["MIT License", "Copyright (c) 2020 Some One", MIT.split("One. ")[1].split("\n")[0].replace("conditions.", "conditions:"), "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", AS_IS],
    "BSD-3-Clause": [
        *BSD[:4],
        "3. Neither the name of Some Firm nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ],
    "GPL-2.0-or-later": [
        "Frobnicator is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        GPL[1],
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Boston",
    ],
    "AGPL-3.0-or-later": [GPL[0].replace("GNU", "GNU Affero"), GPL[1].replace("GNU", "GNU Affero"), GPL[2].replace("GNU", "GNU Affero")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Copyright (c) 2004-2010 by Some One",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    ],
    "Apache-2.0": APACHE,
}


@pytest.mark.parametrize("licence", FULL)
def test_full_texts_match_their_longest_rule(spark, licence):
    rule = next(needed for name, needed in ls.RULES if name == licence)
    shapes = [wrapped(FULL[licence], w, p) for w in (50, 72, 80) for p in ("", " * ", "# ")] + [" ".join(FULL[licence]), "\n".join(FULL[licence]), "\n\n".join(FULL[licence])]
    for text in shapes:
        ids = ls.text_ids(text.lower())
        assert [i for i in ids if i != "copyright"] == list(rule), text
    rows = ls.scan_licences(spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string")).collect()
    assert len(rows) == len(shapes) and {r["licences"].split(",unmatched")[0] for r in rows} == {licence}


def test_long_sentences_inside_others_leave_the_rest_readable():
    grant = "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    assert ls.text_ids(f"all rights reserved\nsome words and {grant} and on\nlicensed under cc by 4.0") == ["all_rights", "zlib_grant", "cc_by_line"]


def test_odd_rows(odd_docs, no_docs):
    assert ls.scan_licences(odd_docs).count() == 0 and ls.scan_licences(no_docs).count() == 0

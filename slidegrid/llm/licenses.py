r"""Licence recognition by sentence rules.

A text is normalised (A-Z lowered, https taken as http, runs of anything but letters a-z and digits to one blank) and the
sentences of a fixed table are looked for in it from left to right, the longest first where several begin; what is known
becomes the text's sequence of sentence identifiers, in order. Rules are ordered sequences of identifiers; the sequence is
read from left to right too and the longest rule that begins at a place takes its sentences, so parts of a longer notice
don't count as shorter notices. Pieces that speak of a licence but aren't known are counted. Only DataFrame functions are
used and nothing is shuffled; sentences and rules are one pattern each, so the plan doesn't grow with the table.

Ends are line feeds, and full stops, exclamation and question marks and colons before a blank; a full stop between v and a
number, which may stand in the next line's comment, is none. A known sentence starts and stops at ends and may run over line feeds and colons, so notices may be wrapped
and indented or commented by signs; it does not run over the other ends. What speaks of a licence is counted by line feeds,
full stops, exclamation and question marks, without the known sentences. The clause of the BSD licences on names may name
any holder. Null and empty texts have no sentences; repeated rows are judged each for itself; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, and the notices that they make up.
SENTENCES = {
    "apache2_line": "Licensed under the Apache License, Version 2.0.",
    "apache2_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2_see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit_line": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_title": "The MIT License (MIT)",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit0_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "mpl2_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0.",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_grant_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib_product": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "zlib_altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib_notice": "This notice may not be removed or altered from any source distribution.",
    "cc0_dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0_warranty": "This software is distributed without any warranty.",
    "cc0_copy": "You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense_more": "For more information, please refer to <http://unlicense.org/>",
    "boost_line": "Distributed under the Boost Software License, Version 1.0.",
    "boost_copy": "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "boost_title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
RULES = [
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_basis", "apache2_see")),
    ("Apache-2.0", ("apache2_grant",)),
    ("Apache-2.0", ("apache2_line",)),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_line",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_title",)),
    ("MIT-0", ("mit0_grant", "mit_warranty")),
    ("BSD-4-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_subject",)),
    ("ISC", ("isc_grant", "isc_warranty")),
    ("ISC", ("isc_grant_and", "isc_warranty")),
    ("0BSD", ("0bsd_grant", "isc_warranty")),
    ("Zlib", ("zlib_as_is", "zlib_liability", "zlib_grant", "zlib_origin", "zlib_product", "zlib_altered", "zlib_notice")),
    ("CC0-1.0", ("cc0_dedicated", "cc0_warranty", "cc0_copy")),
    ("CC0-1.0", ("cc0_dedicated",)),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("Unlicense", ("unlicense_free",)),
    ("BSL-1.0", ("boost_title", "boost_grant")),
    ("BSL-1.0", ("boost_line", "boost_copy")),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_line",)),
]

# The GNU licences with the versions of their notices, the kinds of the Creative Commons, names for one-line tags.
GNU = (("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3"))
CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
TAGS = (
    "Apache-2.0", "MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)


def _add(name: str, *sentences: tuple[str, str]) -> None:
    SENTENCES.update(sentences)
    RULES.append((name, tuple(k for k, _ in sentences)))


for _short, _long, _version in GNU:
    _key, _name = f"{_short.lower()}{_version.replace('.', '')}", f"{_short}-{_version if '.' in _version else _version + '.0'}"
    _full = f"GNU {_long} Public License"
    _see = (f"{_short.lower()}_see", f"See the {_full} for more details.")
    for _what in ("program", "library"):
        _useful = (f"{_what}_useful", f"This {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
        _free = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the {_full}"
        _later = (f"{_key}_{_what}_later", f"{_free} as published by the Free Software Foundation; either version {_version} of the License, or (at your option) any later version.")
        _only = [(f"{_key}_{_what}_only", f"{_free} version {_version} as published by the Free Software Foundation."), (f"{_key}_{_what}_only_comma", f"{_free}, version {_version}, as published by the Free Software Foundation.")]
        for _first, _end in ((_later, "or-later"), (_only[0], "only")):
            _add(f"{_name}-{_end}", _first, _useful, _see)
            _add(f"{_name}-{_end}", _first)
    _add(f"{_name}-only", (f"{_key}_line", f"This work is licensed under the {_full}, version {_version}."))
for _short, _long in CREATIVE:
    _key = _short.lower().replace("-", "")
    _add(f"CC-{_short}-4.0", (f"cc{_key}4_line", f"Licensed under CC {_short} 4.0."))
    _add(f"CC-{_short}-4.0", (f"cc{_key}4_work", f"This work is licensed under a Creative Commons {_long} 4.0 International License."))
    _add(f"CC-{_short}-3.0", (f"cc{_key}3_work", f"This work is licensed under a Creative Commons {_long} 3.0 Unported License."))
for _tag in TAGS:
    _add(_tag, (f"spdx_{_tag.lower().replace('.', '')}", f"SPDX-License-Identifier: {_tag}"))


def normalised(sentence: str) -> str:
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower())
    return " ".join(words.split())


def _alternatives(gap: str) -> str:
    """All known sentences, the longest first, with gap before the blank between two words."""
    return "|".join(s.replace(" ", f"{gap} ") for s in sorted({normalised(s) for s in SENTENCES.values()}, key=lambda s: (-len(s), s)))


def _holder(gap: str) -> str:
    """The clause on names with any holder's name, of twelve words at most."""
    fixed = lambda words: "".join(f"{gap} {w}" for w in words.split())
    return "neither" + fixed("the name of") + f"(?:{gap} [a-z0-9]+){{1,12}}?" + fixed("nor the names of") + f"{gap} (?:its|the|any)" + fixed("contributors")


HOLDER = "neither the name of the copyright holder nor the names of its contributors"
_BLANK = r"[\x20\x09-\x0D]"
_SPEAKS = "(^| )licen[cs]e(d|s)?( |$)"
_KNOWN = {normalised(s): k for k, s in SENTENCES.items()}
_RUNS = {"".join(f";{i};" for i in ids): name for name, ids in RULES}
_RULE = "|".join(sorted(_RUNS, key=lambda run: (-run.count(";"), run)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (joined by blanks, in order), n_known, n_unknown, and licenses, the sorted names of matched
    rules joined by commas."""
    # Capital letters are marks: H and L end sentences, H (full stops and the like) for good, S is a colon before a blank.
    x = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    x = F.regexp_replace(F.replace(x, F.lit("https://"), F.lit("http://")), rf"(^|[^a-z0-9])v\.{_BLANK}[\x20\x09-\x0D#*/;%-]*([0-9])", "$1v $2")
    x = F.replace(F.regexp_replace(x, rf"[.!?]{_BLANK}+", " H "), F.lit("\n"), F.lit(" L "))
    x = F.regexp_replace(x, rf":(?={_BLANK})", " S ")
    x = F.concat(F.lit("H "), F.trim(F.regexp_replace(x, "[^a-z0-9HLS]+", " ")), F.lit(" H"))
    gap = "(?: [LS])*"
    marked = docs.select("doc_id", x.alias("x"))
    marked = marked.withColumn("x", F.when(F.contains("x", F.lit("neither")), F.regexp_replace("x", f"(?<= ){_holder(gap)}(?= )", HOLDER)).otherwise(F.col("x")))
    pattern = f"(?<=[HLS] )(?:{_alternatives(gap)})(?= [HLS])"
    ids = F.transform(F.regexp_extract_all("x", F.lit(pattern), F.lit(0)), lambda m: _lookup(_KNOWN, F.regexp_replace(m, " [LS](?= )", "")))
    pieces = F.split(F.regexp_replace("x", pattern, "K"), "[HL]")
    rows = marked.select("doc_id", ids.alias("ids"), F.size(F.filter(pieces, lambda p: p.rlike(_SPEAKS))).cast("long").alias("n_unknown"))
    run = F.array_join(F.transform("ids", lambda i: F.concat(F.lit(";"), i, F.lit(";"))), "")
    names = F.transform(F.regexp_extract_all(run, F.lit(_RULE), F.lit(0)), lambda m: _lookup(_RUNS, m))
    return rows.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.size("ids").cast("long").alias("n_known"), "n_unknown", F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"))


def _sql() -> str:
    """DuckDB's patterns can't look around, so marks are written twice: each sentence takes one on either side."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    gap = "(?: [LS] [LS])*"
    table = lambda t: "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in t.items()) + "}"
    sentences = _alternatives(gap)
    return rf"""
with a as (select row_number() over () as rid, doc_id, replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'https://', 'http://') as t from documents),
b as (select rid, doc_id, replace(regexp_replace(regexp_replace(t, '(^|[^a-z0-9])v\.{_BLANK}[\x20\x09-\x0D#*/;%-]*([0-9])', '\1v \2', 'g'), '[.!?]{_BLANK}+', ' H H ', 'g'), chr(10), ' L L ') as t from a),
c as (select rid, doc_id, 'H H ' || trim(regexp_replace(regexp_replace(t, ':({_BLANK})', ' S S \1', 'g'), '[^a-z0-9HLS]+', ' ', 'g')) || ' H H' as t from b),
d as (select rid, doc_id, case when contains(t, 'neither') then regexp_replace(t, ' {_holder(gap)} ', ' {HOLDER} ', 'g') else t end as t from c),
e as (select rid, doc_id, list_transform(regexp_extract_all(t, '[HLS] ({sentences}) [HLS]', 1), lambda m: ({table(_KNOWN)})[regexp_replace(m, ' [LS] [LS]', '', 'g')]) as ids,
  len(list_filter(regexp_split_to_array(regexp_replace(t, '([HLS] )(?:{sentences})( [HLS])', '\1K\2', 'g'), '[HL]'), lambda p: regexp_matches(p, '{_SPEAKS}'))) as n_unknown from d),
f as (select doc_id, ids, n_unknown, list_transform(regexp_extract_all(array_to_string(list_transform(ids, lambda i: ';' || i || ';'), ''), '{_RULE}'), lambda m: ({table(_RUNS)})[m]) as names from e)
select doc_id, array_to_string(ids, ' ') as sentence_ids, len(ids)::bigint as n_known, n_unknown::bigint as n_unknown, array_to_string(list_sort(list_distinct(names)), ',') as licenses from f
"""


SQL = _sql()

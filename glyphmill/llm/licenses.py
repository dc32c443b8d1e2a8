"""License scans by conditional compression.

Candidate blocks of a text are lines, or runs of near lines, that hold a license word. Each is compressed by zstandard
alone and with every template as a raw dictionary. A template is a candidate if it saves a share of the bytes that it
needs itself, so that what else a block holds does not dilute it, and the bytes saved rank the candidates. All of them
are confirmed in that order by exact wording differences: the words of the template that the block lacks, with the words
that tell the license from its kin (names and version numbers), which must all be there in order. Words that one license
covers are not looked at again, so a block gives each of its licenses; of a notice that lists several after one another
('or', 'and'), each is scanned with the head of the notice.

A null or empty text has no blocks. Long lines are split at sentence ends, so a notice within prose is found; a run of
lines has no upper length. Repeated rows are scanned one by one, an empty table gives an empty result, further columns
are not read. Ties go to the template that saves a greater share of itself, then to the one that stands first.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

TRIGGER = r"(?i)licen[cs]e|copyright|warrant(?:y|ies)|redistribut|public domain|spdx-|permission is hereby|all rights reserved"
#: Lines between two trigger lines of one block at most, and characters over which a line is split into sentences.
GAP = 8
LONG_LINE = 300
#: The least share of a template's own bytes that it saves, and the least share of its words that a block holds.
#: The head of a license's full text, whose version stands on the next line.
HEADING = r"(?i)\W*gnu [a-z ]*licen[cs]e\W*"
LEAST_SAVED = 0.3
LEAST_HELD = 0.85
#: Words that a matched stretch may have beyond twice its template's, and words behind it that may bar it.
SLACK = 20
BEHIND = 2


@dataclass(frozen=True)
class Template:
    """key: words that a block must hold in this order; bars: words that it must not hold between or after them."""

    license: str
    text: str
    key: tuple[str, ...]
    bars: tuple[str, ...] = ()


# Wordings of license notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
    "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
    "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_BSD_OPEN = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is released under CC0 1.0 Universal."


# Names of licenses that carry a version, and the words that Creative Commons codes stand for.
VERSIONED = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("EPL-1.0", "Eclipse Public License 1.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("EUPL-1.1", "European Union Public Licence 1.1"),
    ("EUPL-1.2", "European Union Public Licence 1.2"),
)
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2", "2.1", "3"), "AGPL": ("3",)}
SPELLED = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
#: Heads of notices that may list several licenses, and words that part them.
HEADS = (("licensed", "under"), ("released", "under"), ("distributed", "under"), ("available", "under"), ("spdx", "license", "identifier"))
PARTS = ("or", "and", "either")


def _gnu(name: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version %s of the License, or (at your "
        f"option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {name} for more details."
    )


def all_templates() -> tuple[Template, ...]:
    """Full notices, and the short ones that follow from a license's name and version by rule."""
    out = [
        Template("MIT", _MIT, ("permission", "hereby", "granted", "free", "charge", "sublicense")),
        Template("Apache-2.0", _APACHE, ("apache", "license", "2.0")),
        Template("ISC", _ISC, ("permission", "use", "copy", "modify", "distribute", "fee")),
        Template("BSD-2-Clause", _BSD_OPEN + _BSD_END, ("redistribution", "source", "binary", "disclaimer"), ("neither", "endorse")),
        Template("BSD-3-Clause", _BSD_OPEN + _BSD_NAMES + _BSD_END, ("redistribution", "source", "binary", "neither", "endorse")),
        Template("MPL-2.0", _MPL, ("mozilla", "public", "license", "2.0")),
        Template("Unlicense", _UNLICENSE, ("free", "unencumbered", "public", "domain")),
        Template("CC0-1.0", _CC0, ("cc0",)),
    ]
    for code, name, gnu, bars in (("GPL", "General Public License", ("gnu", "general", "public", "license"), ("lesser", "affero")), ("LGPL", "Lesser General Public License", ("gnu", "lesser", "general", "public", "license"), ()), ("AGPL", "Affero General Public License", ("gnu", "affero", "general", "public", "license"), ())):
        for version in GNU_VERSIONS[code]:
            spdx = f"{code}-{version if '.' in version else version + '.0'}"
            out.append(Template(spdx, _gnu(name) % version, (*gnu, "version", version), bars))
            out.append(Template(spdx, f"This work is licensed under the GNU {name}, version {version}.", (*gnu, version), bars))
            out.append(Template(spdx, f"GNU {name} Version {version}", (*gnu, "version", version), bars))
            out.append(Template(spdx, f"Licensed under {code}v{version}.", (f"{code.lower()}v{version}",)))
            out.append(Template(spdx, f"Licensed under {code} v{version}.", (code.lower(), f"v{version}")))
            number = spdx.split("-")[1]
            out.append(Template(spdx, f"SPDX-License-Identifier: {spdx}", ("spdx", "license", "identifier", code.lower(), number), ("later", "only")))
            for more in ("or-later", "only"):
                out.append(Template(f"{spdx}-{more}", f"SPDX-License-Identifier: {spdx}-{more}", ("spdx", "license", "identifier", code.lower(), number, *more.split("-"))))
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        parts = tuple(code.lower().split("-"))
        bars = tuple(x for x in ("nc", "sa", "nd") if x not in parts)
        for version in ("3.0", "4.0"):
            out.append(Template(f"CC-{code}-{version}", f"Licensed under CC {code} {version}.", ("cc", *parts, version), bars))
            out.append(Template(f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {code} {version} International License.", ("creative", "commons", *parts, version), bars))
            spelled = tuple(SPELLED[x] for x in parts)
            barred = tuple(w for x in ("nc", "sa", "nd") if x not in parts for w in (SPELLED[x], SPELLED[x].replace("derivatives", "derivs")))
            out.append(Template(f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {'-'.join(spelled)} {version} International License.", ("creative", "commons", *spelled, version), barred))
            out.append(Template(f"CC-{code}-{version}", f"SPDX-License-Identifier: CC-{code}-{version}", ("spdx", "license", "identifier", "cc", *parts, version), bars))
    for spdx, name in (("MIT", "MIT License"), ("ISC", "ISC License"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License")):
        out.append(Template(spdx, f"Released under the {name}.", tuple(name.lower().split())))
        out.append(Template(spdx, f"Licensed under the {name}.", tuple(name.lower().split())))
        out.append(Template(spdx, f"SPDX-License-Identifier: {spdx}", ("spdx", "license", "identifier", spdx.lower())))
    for spdx, name in VERSIONED:
        key = tuple(words(name))
        version = spdx.rsplit("-", 1)[1]
        out.append(Template(spdx, f"Licensed under the {name}.", key))
        out.append(Template(spdx, f"Distributed under the {name}.", key))
        out.append(Template(spdx, name, key))
        out.append(Template(spdx, f"SPDX-License-Identifier: {spdx}", ("spdx", "license", "identifier", spdx.split("-")[0].lower(), version)))
    for n, bars in ((2, ("3",)), (3, ("2",))):
        out.append(Template(f"BSD-{n}-Clause", f"Licensed under the BSD {n}-Clause License.", ("bsd", str(n), "clause"), bars))
        out.append(Template(f"BSD-{n}-Clause", f"SPDX-License-Identifier: BSD-{n}-Clause", ("spdx", "license", "identifier", "bsd", str(n), "clause"), bars))
    return tuple(out)


def words(text: str) -> list[str]:
    return [w.rstrip(".") for w in re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())]


def in_order(key: tuple[str, ...], ws: list[str]) -> bool:
    rest = iter(ws)
    return all(k in rest for k in key)


def alternatives(ws: list[str]) -> list[list[str]]:
    """Each license of a list behind the head of a notice, with that head: what follows a word that parts them, up to the
    next one. A head's list ends at the next head."""
    out = []
    heads = [k for k in range(len(ws)) for h in HEADS if tuple(ws[k : k + len(h)]) == h]
    for at, end in zip(heads, [*heads[1:], len(ws)], strict=False):
        size = next(len(h) for h in HEADS if tuple(ws[at : at + len(h)]) == h)
        part: list[str] = []
        parts = [part]
        own = ws[at + size : end]
        for w, then in zip(own, [*own[1:], ""], strict=True):
            if w in PARTS and then != "later":
                part = []
                parts.append(part)
            else:
                part.append(w)
        if len(parts) > 1:
            spdx = ws[at] == "spdx"
            out += [[*ws[at : at + size], *([] if spdx or p[0] == "the" else ["the"]), *p] for p in parts if p]
    return out


class Scanner:
    def __init__(self, templates: tuple[Template, ...] | None = None, level: int = 9):
        self.templates = templates or all_templates()
        self.words = [words(t.text) for t in self.templates]
        form = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**form)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **form) for w in self.words]
        self.empty = len(self.plain.compress(b""))
        self.own = [self.size(" ".join(w).encode()) for w in self.words]
        self.trigger = re.compile(TRIGGER)

    def size(self, data: bytes) -> int:
        return max(1, len(self.plain.compress(data)) - self.empty)

    def ranked(self, ws: list[str]) -> list[tuple[int, float, int]]:
        """(bytes saved, share of the template's own bytes, template) of the candidates, best first. Block and templates
        are compressed as words, so that case, blanks and comment marks cost nothing."""
        data = " ".join(ws).encode()
        alone = self.size(data)
        saved = [(alone - (len(c.compress(data)) - self.empty), k) for k, c in enumerate(self.given)]
        fit = [(n, n / self.own[k], k) for n, k in saved if n > 0 and n >= LEAST_SAVED * self.own[k]]
        return sorted(fit, key=lambda x: (-x[0], -x[1], x[2]))

    def confirm(self, ws: list[str], template: int) -> tuple[float, str, str, int, int] | None:
        """Share of the template's words that the words hold in order, those it lacks and those it adds within the matched
        stretch, and that stretch; None if the license is another one."""
        own, t = self.words[template], self.templates[template]
        if not in_order(t.key, ws):
            return None
        match = difflib.SequenceMatcher(None, own, ws, autojunk=False)
        anchor = match.find_longest_match()
        low = max(0, anchor.b - anchor.a - len(own) - SLACK)
        near = ws[low : anchor.b + 2 * len(own) + SLACK]
        match.set_seq2(near)
        same = [m for m in match.get_matching_blocks() if m.size]
        held = sum(m.size for m in same) / len(own)
        if held < LEAST_HELD:
            return None
        lo, hi = same[0].b, same[-1].b + same[-1].size
        stretch = near[lo:hi]
        if len(stretch) > 2 * len(own) + SLACK or not in_order(t.key, stretch) or any(b in near[lo : hi + BEHIND] for b in t.bars):
            return None
        lacks, adds = [], []
        for op, a, b, c, d in match.get_opcodes():
            if op != "equal":
                lacks += own[a:b]
                if c >= lo and d <= hi:
                    adds += near[c:d]
        return held, " ".join(lacks), " ".join(adds), low + lo, low + hi

    def told(self, block: str) -> list[tuple[str, float, float, str, str]]:
        """(license, saved, held, lacks, adds) of each license of a block, once."""
        out: list[tuple[str, float, float, str, str]] = []
        whole = words(block)
        for ws in (whole, *alternatives(whole)):
            left = list(ws)
            for _, share, k in self.ranked(ws):
                got = self.confirm(left, k)
                if got:
                    held, lacks, adds, lo, hi = got
                    left[lo:hi] = [""]  # covered; no template has an empty word
                    if not any(x[0] == self.templates[k].license for x in out):
                        out.append((self.templates[k].license, share, held, lacks, adds))
        return out

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of candidate blocks: trigger lines, run together over gaps of some lines and on to the next blank line;
        and each alone. Long lines go by sentences."""
        pieces, at = [], 0
        for line in text.split("\n"):
            if len(line) > LONG_LINE:
                pieces += [(at + m.start(), at + m.end()) for m in re.finditer(r".+?(?:[.!?](?=\s)|$)", line)]
            else:
                pieces.append((at, at + len(line)))
            at += len(line) + 1
        hits = [k for k, (s, e) in enumerate(pieces) if self.trigger.search(text, s, e)]
        k = 0
        while k < len(hits):
            j = k
            while j + 1 < len(hits) and hits[j + 1] - hits[j] <= GAP:
                j += 1
            if j > k:
                last = hits[j]
                while last + 1 < len(pieces) and last < hits[j] + GAP and text[slice(*pieces[last + 1])].strip(" \t*#/-;"):
                    last += 1
                yield pieces[hits[k]][0], pieces[last][1]
            for h in hits[k : j + 1]:
                if h + 1 < len(pieces) and re.fullmatch(HEADING, text[slice(*pieces[h])]):
                    yield pieces[h][0], pieces[h + 1][1]
                yield pieces[h]
            k = j + 1

    def scan(self, text: str) -> list[tuple[int, int, str, float, float, str, str]]:
        """(start, end, license, saved, held, lacks, adds), the wider block first; a block inside one that is confirmed
        with the same license is not told again."""
        out: list[tuple[int, int, str, float, float, str, str]] = []
        for start, end in self.blocks(text):
            for name, *rest in self.told(text[start:end]):
                if not any(s <= start and end <= e and n == name for s, e, n, *_ in out):
                    out.append((start, end, name, *rest))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed block: doc_id, start, end (code points), license, saved, held, lacks, adds. Only texts
    that hold a license word leave the JVM."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, end long, license string, saved double, held double, lacks string, adds string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept("licenses", Scanner)
        for rows in slices(batches):
            found = [(d, *x) for d, t in zip(rows["doc_id"], rows["text"], strict=True) for x in scanner.scan(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in found], schema=arrow)

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.where(F.col("text").rlike(TRIGGER)).mapInArrow(run, schema)

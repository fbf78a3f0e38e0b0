"""License scans by conditional compression.

Texts are cut into words. A stretch that holds words which only few wordings
have, over line ends too, is a candidate block. It is compressed with the texts of each
license as raw zstandard dictionary, and the licenses are ranked by what
that saves. Those that save most are confirmed by their exact differences, word
by word; names and versions of licenses must not differ.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import chunks

#: License texts and the customary notices of licenses, whole.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
        'http://www.apache.org/licenses/LICENSE-2.0\n'
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        'Released under the MIT License.',
        'This project is licensed under the MIT License.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n'
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    ),
    "ISC": (
        'Released under the ISC License.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n'
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    ),
    "0BSD": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n'
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        'Released under the zlib License.',
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n'
        '1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n'
        '2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n'
        '3. This notice may not be removed or altered from any source distribution.',
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    "BSL-1.0": (
        'Distributed under the Boost Software License, Version 1.0.',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n'
        'The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n'
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        'This work is licensed under the GNU General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n'
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ),
    "GPL-2.0": (
        'This work is licensed under the GNU General Public License, version 2.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n'
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
    ),
    "LGPL-3.0": (
        'This library is licensed under the GNU Lesser General Public License, version 3.',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n'
        'This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ),
    "LGPL-2.1": (
        'This library is licensed under the GNU Lesser General Public License, version 2.1.',
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n'
        'This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    ),
    "AGPL-3.0": (
        'This work is licensed under the GNU Affero General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n'
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ),
    "BSD-3-Clause": (
        'Licensed under the BSD 3-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n'
        '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n'
        '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n'
        '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n'
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-2-Clause": (
        'Licensed under the BSD 2-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n'
        '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n'
        '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n'
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "MPL-2.0": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.',
    ),
    "EPL-2.0": (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.',
    ),
    "CC-BY-4.0": (
        'Licensed under CC BY 4.0.',
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    ),
    "CC-BY-SA-4.0": (
        'Licensed under CC BY-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    ),
    "CC-BY-NC-4.0": (
        'Licensed under CC BY-NC 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    ),
    "CC-BY-ND-4.0": (
        'Licensed under CC BY-ND 4.0.',
        'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    ),
    "CC0-1.0": (
        'To the extent possible under law, the author has waived all copyright and related rights to this work.',
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain.\n'
        'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n'
        'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n'
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'This is free and unencumbered software released into the public domain.',
    ),
    "proprietary": (
        'All rights reserved.',
    ),
}

#: Words that tell licenses apart. Words that are versions tell them apart as well.
NAMES = frozenset("affero agpl apache attribution attribution-noderivatives attribution-noncommercial attribution-sharealike boost bsd by-nc by-nd by-sa cc commons eclipse gnu gpl isc lesser lgpl mit mozilla mpl epl noncommercial noderivatives sharealike unlicense zlib".split())
VERSION = re.compile(r"v?\d{1,2}(\.\d+)*|\d-clause")


WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Signs after the last word that belong to a notice.
TAIL = re.compile(r"[.:;,!)\"']*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Compressors of all licenses, and the words of each wording.

    A wording is confirmed if the words that miss and those in between are no
    more than the share ``most`` of its own, and none of them names a license or a version.
    """

    #: Licenses that save at least this share of what the first confirmed one saves are held against it.
    NEAR = 0.8

    def __init__(self, templates: dict[str, tuple[str, ...]], most: float = 0.34) -> None:
        # the level of the best parse, as faster ones miss short matches in a dictionary, and a window over all of it
        window = max(17, 1 + max((len("\n".join(t).encode()) for t in templates.values()), default=0).bit_length())
        params = zstandard.ZstdCompressionParameters.from_level(19, window_log=window)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.own: dict[str, zstandard.ZstdCompressor] = {}
        self.wordings: list[tuple[str, list[str], int]] = []
        self.of: dict[str, list[int]] = {}
        for name, texts in templates.items():
            raw = "\n".join(texts).encode()
            self.own[name] = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for t in texts:
                w = words(t)
                if w:
                    self.of.setdefault(name, []).append(len(self.wordings))
                    self.wordings.append((name, w, int(most * len(w))))
        # a confirmed wording keeps one of any n_missing + 1 of its words: its rarest are the cues
        spread = Counter(w for _, wording, _ in self.wordings for w in set(wording))
        self.cues: dict[str, list[int]] = {}
        for k, (_, wording, room) in enumerate(self.wordings):
            order = sorted(range(len(wording)), key=lambda i: (spread[wording[i]], -len(wording[i]), i))
            for w in {wording[i] for i in order[: room + 1]}:
                self.cues.setdefault(w, []).append(k)
        #: The wordings that have a word, and how many different words of each must be there.
        self.having: dict[str, list[int]] = {}
        for k, (_, wording, _) in enumerate(self.wordings):
            for w in set(wording):
                self.having.setdefault(w, []).append(k)
        self.needed = [len(set(wording)) - room for _, wording, room in self.wordings]

    def possible(self, own: set[str]) -> set[int]:
        """Wordings of which a text of these words has enough different ones."""
        count = Counter(k for w in own & self.having.keys() for k in self.having[w])
        return {k for k, n in count.items() if n >= self.needed[k]}

    def reduction(self, block: str, name: str) -> float:
        """Share of the block's compressed size that the license's texts save."""
        raw = block.encode("utf-8", "surrogatepass")
        return 1 - len(self.own[name].compress(raw)) / len(self.plain.compress(raw))

    def align(self, k: int, mine: list[str]) -> tuple | None:
        """(cost, from, to, missing, added) of the stretch of ``mine`` that differs least from wording ``k``; none if it differs too much.

        Words go missing or are added, one a step; what stands before and after the stretch costs nothing.
        """
        _, wording, room = self.wordings[k]
        number = {w: i for i, w in enumerate(dict.fromkeys(wording))}
        own, other = np.array([number[w] for w in wording]), np.array([number.get(w, -1) for w in mine])
        step = np.arange(len(mine) + 1)
        cost = np.zeros((len(wording) + 1, len(mine) + 1), np.int32)
        for i, w in enumerate(own):
            best = cost[i] + 1
            best[1:] = np.where(other == w, np.minimum(best[1:], cost[i][:-1]), best[1:])
            cost[i + 1] = np.minimum.accumulate(best - step) + step
        end = int(cost[-1].argmin())
        if cost[-1, end] > room:
            return None
        i, j, missing, added = len(wording), end, [], []
        while i:
            if j and other[j - 1] == own[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i - 1, j] + 1:
                i -= 1
                missing.append(wording[i])
            else:
                j -= 1
                added.append(mine[j])
        if any(w in NAMES or VERSION.fullmatch(w) for w in (*missing, *added)):
            return None
        return int(cost[-1, end]), j, end, missing[::-1], added[::-1]

    def blocks(self, places: list[tuple], possible: set[int]) -> list[tuple[int, int, dict[int, list[int]]]]:
        """(from, to, places of cues by wording) of the stretches of a text that hold enough words of some wording; overlapping ones are one block."""
        seen: dict[int, list[int]] = {}
        for i, (w, _, _) in enumerate(places):
            for k in self.cues.get(w, ()):
                if k in possible:
                    seen.setdefault(k, []).append(i)
        spans = []
        for k, hits in seen.items():
            _, wording, room = self.wordings[k]
            bag, reach = Counter(wording), len(wording) + room
            for i in hits:
                low, high = max(0, i - reach), min(len(places), i + reach + 1)
                # windows that hold too few of the wording's words cannot be confirmed
                if sum((bag & Counter(p[0] for p in places[low:high])).values()) >= len(wording) - room:
                    spans.append((low, high, k, i))
        out: list[tuple[int, int, dict[int, list[int]]]] = []
        for low, high, k, i in sorted(spans):
            if out and low < out[-1][1]:
                start, end, cues = out[-1]
                out[-1] = (start, max(end, high), cues)
            else:
                out.append((low, high, {}))
            out[-1][2].setdefault(k, []).append(i)
        return out

    def find(self, text: str) -> list[tuple]:
        """(from, to, license, reduction, missing, added, words that differ, verdict) of each confirmed notice; code points.

        Each candidate block is compressed with the texts of every license, and
        licenses are ranked by what they save; one that saves nothing is out. They are held against the block word
        by word in that order, up to the first that the words confirm; those that save nearly as much compete with it,
        and the least share of words that differ wins, then the longer wording, then the higher rank.
        What stands before and after the notice is a block again.
        """
        possible = self.possible(set(words(text)))
        if not possible:
            return []
        places = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        todo = [(low, high) for low, high, _ in self.blocks(places, possible)]
        out = []
        while todo:
            low, high = todo.pop()
            won = self._winner(text, places, low, high)
            if won is None:
                continue
            a, b, name, missing, added = won
            start, end = places[a][1], TAIL.match(text, places[b - 1][2]).end()
            differ = " ".join([*("-" + w for w in missing), *("+" + w for w in added)])
            out.append((start, end, name, self.reduction(text[start:end], name), len(missing), len(added), differ, "variant" if differ else "exact"))
            todo += [(x, y) for x, y in ((low, a), (b, high)) if x < y]
        return sorted(out)

    def _winner(self, text: str, places: list[tuple], low: int, high: int) -> tuple | None:
        mine = [p[0] for p in places[low:high]]
        bag = Counter(mine)
        # a wording of which too few words are there is none; nothing is compressed where there is no other
        able = {k for k, (_, wording, room) in enumerate(self.wordings) if sum((bag & Counter(wording)).values()) >= len(wording) - room}
        if not able:
            return None
        block = " ".join(text[places[low][1] : places[high - 1][2]].split())
        saved = {name: self.reduction(block, name) for name in self.own}
        found, least = [], 0.0
        for rank, name in enumerate(sorted(saved, key=lambda name: (-saved[name], name))):
            if saved[name] <= 0 or (found and saved[name] < least):
                break
            for k in self.of.get(name, ()):
                if k in able and (got := self.align(k, mine)):
                    if not found:
                        least = self.NEAR * saved[name]
                    size = len(self.wordings[k][1])
                    found.append((got[0] / size, -size, rank, low + got[1], low + got[2], name, got[3], got[4]))
        return min(found)[3:] if found else None


def read_templates(folder: str) -> dict[str, tuple[str, ...]]:
    """License texts of a folder on the driver, one a file, by the file's name: for ``scan`` and its ``templates``."""
    from pathlib import Path

    return {p.stem if p.suffix == ".txt" else p.name: (p.read_text("utf-8", "replace"),) for p in sorted(Path(folder).iterdir()) if p.is_file()}


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, line, start, length, license, reduction, n_missing, n_added, difference, verdict): confirmed notices.

    Whole texts of ``docs`` (doc_id, text) are read, with no shuffle; a notice
    may run over line ends, and ``line`` is that of its first word. ``start``
    and ``length`` are code points of the notice's words and the signs that end it. A null or empty text
    has none; repeated rows give repeated findings; a null id stays null.
    """
    own = templates or TEMPLATES
    names = ["doc_id", "line", "start", "length", "license", "reduction", "n_missing", "n_added", "difference", "verdict"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own)
        for batch in chunks(batches, "text", 16 << 20):
            out = []
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for start, end, *found in scanner.find(text or ""):
                    out.append((ident, text.count("\n", 0, start), start, end - start, *found))
            cols = zip(*out) if out else ((),) * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, line long, start long, length long, license string, reduction double, n_missing long, n_added long, difference string, verdict string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

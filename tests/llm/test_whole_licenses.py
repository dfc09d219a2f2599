"""Every rule on its notice as it is published, and notices that only one of the readings finds."""

import pandas as pd

from discoforge.llm import licenses
from tests.comparing import duck

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = (
    BSD2
    + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
)
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL = GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
ISC = """Copyright (c) 2021, A. Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
NOTICES = {
    "Apache-2.0": [APACHE, "Licensed under the Apache License, Version 2.0.", APACHE.partition("\nYou may")[0]],
    "MIT": [MIT, MIT.partition("\n\nTHE SOFTWARE")[0], "Released under the MIT License.", "Licensed under the MIT License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 3."],
    "GPL-3.0-or-later": [GPL3, " ".join(GPL3.split()), "\n".join(f" * {x}".rstrip() for x in GPL3.split("\n"))],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2."],
    "GPL-2.0-or-later": [GPL2, " ".join(GPL2.split())],
    "BSD-3-Clause": [BSD3, BSD3.replace("the copyright holder nor", "Example Labs, Inc. nor"), "Copyright (c) 1999 Example Labs\n\n" + BSD3],
    "BSD-2-Clause": [BSD2],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "MPL-2.0": [MPL, " ".join(MPL.split())],
    "all-rights-reserved": ["All rights reserved."],
    "LGPL-2.1-or-later": [LGPL],
    "LGPL-3.0-or-later": [GPL3.replace("GNU General", "GNU Lesser General")],
    "AGPL-3.0-or-later": [GPL3.replace("GNU General", "GNU Affero General")],
    "ISC": [ISC],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE],
    "BSL-1.0": [BOOST, "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file.)"],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSD": ["Licensed under the BSD license."],
}


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["licenses"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_every_rule_on_its_notice(spark):
    assert set(NOTICES) == {name for name, _ in licenses.RULES}
    cases = [(name, text) for name, texts in NOTICES.items() for text in texts]
    assert found(spark, [text for _, text in cases]) == [[name] for name, _ in cases]


def test_licences_of_both_readings(spark):
    lines = "Released under the MIT License\nAll rights reserved\nLicensed under CC BY 4.0\nsome more words"
    one_line = "\n".join(" ".join(x.split()) for x in BSD2.split("\n\n"))
    wrapped = BSD3.split("\n\n")[-1]
    assert found(spark, [APACHE + "\n\n" + lines, "All rights reserved\nhere\n\n" + GPL3, one_line + "\n\n" + wrapped]) == [
        ["Apache-2.0", "CC-BY-4.0", "MIT", "all-rights-reserved"],
        ["GPL-3.0-or-later", "all-rights-reserved"],
        ["BSD-3-Clause"],
    ]


def test_marks_between_other_sentences_stay(spark):
    assert found(spark, ["This program is free software; enjoy it. Licensed under the MIT License.", "All of it without any warranty; Licensed under the MIT License."]) == [["MIT"], ["MIT"]]


def test_a_shorter_rule_counts_where_it_stands_alone(spark):
    assert found(spark, [BSD2 + "\n\nPart two of the text.\n\n" + BSD3, BSD3]) == [["BSD-2-Clause", "BSD-3-Clause"], ["BSD-3-Clause"]]


def test_sql_reads_the_notices_alike(spark, tmp_path):
    texts = [text for texts in NOTICES.values() for text in texts] + [APACHE + "\n\nReleased under the MIT License\n" + BSD3 + "\n\n" + BSD2, None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: (r.licenses, r.sentences) for r in duck(licenses.oracle(), str(tmp_path)).itertuples()}
    assert {r["doc_id"]: (",".join(r["licenses"]), ",".join(r["sentences"])) for r in licenses.scan(table).collect()} == want

"""Licence sentences as they ship: wrapped, commented, long, and by name."""

import re

import pytest

from playseq.llm.licenses import RULES, SENTENCES, TELLS, known_sentences, match_rules, normalise

PATTERNS = [(name, re.compile(pattern)) for name, pattern in SENTENCES]

MIT = """MIT License

Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""

APACHE = """Licensed under the Apache License, Version 2.0 (the
"License"); you may not use this file except in
compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""

GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions in the documentation.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def licences(text):
    return [name for name, _, _ in match_rules(known_sentences(text, PATTERNS), RULES)]


@pytest.mark.parametrize("leader", ["", "# ", "// ", " * ", ";; "])
@pytest.mark.parametrize("text,want", [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL, "GPL-2"), (BSD, "BSD-3-Clause"), (BSD.split("3. ")[0], "BSD-2-Clause")])
def test_shipped_texts(text, want, leader):
    commented = "\n".join(leader + line for line in text.split("\n"))
    assert set(licences(commented)) == {want}


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("Released under the GPL v2.", "GPL-2"),
        ("Distributed under the LGPL 2.1", "LGPL-2.1"),
        ("Released under CC BY 4.0.", "CC-BY-4.0"),
        ("This project is released under the MIT License.", "MIT"),
        ("MIT License", "MIT"),
        ("The MIT License (MIT)", "MIT"),
        ("This library is available under the terms of the Apache License, Version 2.0.", "Apache-2.0"),
        ("The code is licensed under the 3-clause BSD license.", "BSD-3-Clause"),
        ("Licensed under GPL version 3 or any later version.", "GPL-3-or-later"),
        ("This work has been released into the public domain.", "public-domain"),
    ],
)
def test_names(sentence, want):
    assert licences(sentence) == [want]
    assert licences(f"Some words\n{sentence}\nother words without an end") == [want]
    assert licences(f"Before. {sentence.rstrip('.')}. After.") == [want]


def test_no_licence():
    for text in ("", "A licence to kill.", "Nobody gave permission. The gpl is long.", "warranty " * 5000, ";\n" * 5000 + "license"):
        assert licences(text) == []


def test_each_pattern_has_a_tell():
    examples = [MIT, APACHE, GPL, BSD, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided x."]
    examples += ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "All rights reserved."]
    examples += ["Released under the GPL v2.", "Licensed under GPL v2 or any later version", "Licensed under the LGPL 2.1", "Released under CC BY 4.0"]
    examples += ["Released under the 2-clause BSD license", "Released under MIT license", "This file is in the public domain"]
    assert {k.sentence for text in examples for k in known_sentences(text, PATTERNS)} == {name for name, _ in SENTENCES}
    for example in examples:
        for k in known_sentences(example, PATTERNS):
            assert TELLS.search(example, k.first, k.past)


def test_places_of_a_long_sentence():
    text = "Intro. " + "THE SOFTWARE IS PROVIDED AS IS, without warranty of any kind, express or implied " + "and so on " * 2000 + "license. End."
    (found,) = known_sentences(text, PATTERNS)
    assert (found.sentence, found.first, found.past) == ("mit-warranty", 7, len(text) - 6)


def test_every_cut_by_brute_force():
    """All sentences, clauses and lines of a text, each tried against each pattern without looking for tells."""
    text = "\n\n".join([MIT, "No license here.", APACHE, "Released under the GPL v2\nand more", GPL, BSD, "x; MIT License; y"])
    want = []
    for sentence in re.split(r"(?:(?<!\bv)\.|[!?])(?=\s|\Z)|\n(?=[^\w\n]*(?:\n|\Z))", text):
        levels = [[sentence]]
        for cut in (r"(?<=[^\s;]);|[!?]", r"\n"):
            known = [any(p.fullmatch(normalise(part)) for _, p in PATTERNS) for part in levels[-1]]
            levels.append([x for part, k in zip(levels[-1], known, strict=True) for x in ([part] if k else re.split(cut, part))])
        for part in levels[-1]:
            want += [name for name, p in PATTERNS if p.fullmatch(normalise(part))][:1]
    assert [k.sentence for k in known_sentences(text, PATTERNS)] == want

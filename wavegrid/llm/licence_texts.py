"""Known licences: the published texts in ``licences/``, whole and as they are,
and one-line notices."""

from __future__ import annotations

from pathlib import Path

_FOLDER = Path(__file__).parent / "licences"

# SPDX identifiers, title lines and notices as published.

#: Titles that may stand in front of a text that is published without one.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense"],
}

#: Last line of the terms; what follows tells how to apply them and may be left out.
END = "END OF TERMS AND CONDITIONS"

#: One-line notices.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
]


def _licences() -> list[tuple[str, str]]:
    """(identifier, text) of every form of every text, by file name."""
    found = []
    for file in sorted(_FOLDER.glob("*.txt")):
        name, text = file.stem.removesuffix("-header"), file.read_text(encoding="utf8")
        found.append((name, text))
        found += [(name, f"{title}\n\n{text}") for title in TITLES.get(name, [])]
        if END in text:
            terms = text[: text.index(END)]
            found += [(name, terms), (name, terms + END)]
    return found


#: Whole texts.
LICENCES = _licences()

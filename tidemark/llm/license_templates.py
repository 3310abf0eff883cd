"""Templates of common licences: references by name, published notices, and full texts. Fixed values.

The references are made alike for every licence, from its names and its SPDX identifier. The notices are
what the publishers ask to be put into each file. The full texts lie in the folder ``licenses``; the
Creative Commons licences but CC0 are known by reference and notice only.
"""

from __future__ import annotations

from pathlib import Path

#: Names after "Licensed under"; the first one with "the".
_NAMES = {
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "MIT": ["MIT License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
}

#: What a notice calls the work.
_KINDS = ("program", "library", "file")
_GNU_2 = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published "
    "by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
)
_GNU_3 = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
_NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ],
    "GPL-2.0": [_GNU_2.format(own, "General Public License", "2") for own in _KINDS],
    "GPL-3.0": [_GNU_3.format(own, "General Public License") for own in _KINDS],
    "LGPL-2.1": [_GNU_2.format(own, "Lesser General Public License", "2.1") for own in _KINDS],
    "LGPL-3.0": [_GNU_3.format(own, "Lesser General Public License") for own in _KINDS],
    "AGPL-3.0": [_GNU_3.format(own, "Affero General Public License") for own in _KINDS],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: The full texts as published, by licence.
FULL_TEXTS = {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _templates(license: str) -> list[str]:
    first, *more = _NAMES[license]
    references = [f"Licensed under the {first}.", f"SPDX-License-Identifier: {license}"]
    references_too = [f"Licensed under the terms of the {first}.", *(f"Licensed under {name}." for name in more)]
    return references + _NOTICES.get(license, []) + references_too + ([FULL_TEXTS[license]] if license in FULL_TEXTS else [])


TEMPLATES = {license: _templates(license) for license in _NAMES}

"""Templates of the license scan beyond the short notices: full texts, file headers, wordings, SPDX identifiers.

A template is (license, text, percent): a text holds it if it has that percentage of the template's shingles. Long
texts need 80; texts that another license's text nearly repeats need more; sentences in which one word tells the
license or its version need all.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

TEXTS = Path(__file__).resolve().parent / "license_texts"
PERCENT = 80
#: Full texts that another one repeats to 80 percent or more, with the percentage that tells them apart.
CLOSE_TEXTS = {"0BSD": 98, "ISC": 95, "BSD-2-Clause": 95, "BSD-3-Clause": 95, "GFDL-1.2": 99, "GFDL-1.3": 95,
               "GPL-1.0": 90, "LGPL-2.0": 95, "LGPL-2.1": 95}

#: The GNU header of a program, for each license its name and version in the header.
GNU = {
    "GPL-1.0": ("GNU General Public License", "1"), "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.0": ("GNU Library General Public License", "2"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
#: Sentences that stand in file headers, several to a license; all words are needed.
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "may be used to endorse or promote products derived from this software without specific prior written permission"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files", "Use of this source code is governed by an MIT-style license",
            "Use of this source code is governed by the MIT license"],
    "MPL-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
                "subject to the terms of the Mozilla Public License, version 2.0"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0",
                "made available under the terms of the Eclipse Public License v. 2.0"],
    "CC0-1.0": ["has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
}
#: Names of a license in a sentence such as "released under the ...".
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MIT": ["MIT License", "MIT/X11 License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"], "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    **{k: [f"{name}, version {v}", f"{name}, version {v}.0", f"{name} v{v}", f"{k} License"] for k, (name, v) in GNU.items()},
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License v3.0",
                "GNU GPL version 3", "GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"],
}
#: Parts of Creative Commons licenses, by their letters.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
           "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
SUFFIX = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
VERBS = ["licensed", "released", "distributed", "available", "published", "provided", "covered", "redistributed", "shared", "offered"]
#: Identifiers after "SPDX-License-Identifier:".
SPDX = ["0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
        "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2",
        "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0",
        "MS-PL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib"]


def _gnu_headers() -> list[tuple[str, str]]:
    out = []
    for license_id, (name, version) in GNU.items():
        for subject in ("it", "this program", "this library"):
            for when in (f"either version {version} of the License, or", f"version {version} of the License", f"version {version} as published by"):
                by = "" if "published" in when else " as published by the Free Software Foundation"
                out.append((license_id, f"redistribute {subject} and/or modify it under the terms of the {name}{by}, {when}"))
    return out


@lru_cache(1)
def templates() -> list[tuple[str, str, int]]:
    out = [(p.stem, p.read_text(encoding="utf-8"), CLOSE_TEXTS.get(p.stem, PERCENT)) for p in sorted(TEXTS.glob("*.txt"))]
    names = {k: list(v) for k, v in NAMES.items()}
    for part, words in COMMONS.items():
        for version in COMMONS_VERSIONS:
            names[f"CC-{part}-{version}"] = [f"CC {part} {version}", f"CC-{part}-{version}", f"Creative Commons {words} {version}",
                                             f"Creative Commons {words} {version} {SUFFIX[version]} License"]
    full = [(k, t) for k, own in HEADERS.items() for t in own] + _gnu_headers()
    for license_id, own in names.items():
        for name in own:
            for verb in VERBS:
                full += [(license_id, f"{verb} under {the}{name}") for the in ("", "the ", "a ")]
            full.append((license_id, f"under the terms of the {name}"))
    for identifier in [*SPDX, *(f"CC-{part}-{version}" for part in COMMONS for version in COMMONS_VERSIONS)]:
        ends = ("", "-only", "-or-later") if "GPL-" in identifier or identifier.startswith("GFDL") else ("",)
        full += [(identifier, f"SPDX-License-Identifier: {identifier}{end}") for end in ends]
    return out + [(k, t, 100) for k, t in full]

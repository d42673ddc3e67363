"""Templates of public licenses: names, notices of file headers, whole texts."""

from __future__ import annotations

from pathlib import Path

# Names of public licenses as headers give them, and their SPDX identifiers.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD two-clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD three-clause License", "BSD-style license"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense", "free and unencumbered software released into the public domain"),
    "Zlib": ("zlib License",),
}
IDENTIFIERS = {
    **{name: (name, f"{name}-only", f"{name}-or-later") for name in NAMES if "GPL" in name},
    **{name: (name,) for name in NAMES if "GPL" not in name},
}
# How a sentence may name a license.
PHRASES = (
    "{}",
    "The {}",
    "License: {}",
    "Licensed under {}",
    "Licensed under the {}",
    "Released under the {}",
    "Distributed under the terms of the {}",
    "This work is licensed under the {}",
    "This project is licensed under the {}",
    "This software is released under the {}, see the LICENSE file for details",
    "This source code is subject to the terms of the {}",
    "Use of this source code is governed by a {} that can be found in the LICENSE file",
)
RESERVED = "Proprietary"
RESERVATIONS = ("All rights reserved", "Copyright (c) <year> <owner>. All rights reserved")
# Words of a name that do not tell one license from another; a sentence must hold all others.
GENERIC = (
    "a", "be", "by", "c", "can", "code", "copyright", "details", "distributed", "file", "for", "found", "governed", "identifier",
    "in", "international", "into", "is", "later", "license", "licensed", "of", "only", "or", "owner", "project", "released",
    "see", "software", "source", "spdx", "style", "subject", "terms", "that", "the", "this", "to", "under", "use", "v", "version",
    "work", "year",
)

# Notices that the licenses ask for in file headers.
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}
Public License as published by the Free Software Foundation, either version {version} of the License, or
(at your option) any later version."""
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "AGPL-3.0": _GPL_NOTICE.format(kind="Affero General", version="3"),
    "GPL-2.0": _GPL_NOTICE.format(kind="General", version="2"),
    "GPL-3.0": _GPL_NOTICE.format(kind="General", version="3"),
    "LGPL-2.1": _GPL_NOTICE.format(kind="Lesser General", version="2.1"),
    "LGPL-3.0": _GPL_NOTICE.format(kind="Lesser General", version="3"),
}
#: Licenses whose grant, a block of their text, is a header by itself: the words that it starts with.
GRANTS = {"MIT": "Permission is", "ISC": "Permission to", "Zlib": "Permission is", "Unlicense": "Anyone is", "BSD-3-Clause": "Redistribution and"}


def templates() -> list[tuple[str, str, str]]:
    """``(license, kind, text)``: names are met by sentences, notices by blocks or whole texts, texts by whole texts."""
    texts = {path.stem: path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    named = {(license, phrase.format(name)) for license, names in NAMES.items() for name in names for phrase in PHRASES}
    named |= {(license, f"SPDX-License-Identifier: {one}") for license, ids in IDENTIFIERS.items() for one in ids}
    named |= {(RESERVED, text) for text in RESERVATIONS}
    grants = [(license, block) for license, start in GRANTS.items() for block in texts[license].split("\n\n") if block.startswith(start)]
    return [
        *((license, "name", text) for license, text in sorted(named)),
        *((license, "notice", text) for license, text in sorted([*NOTICES.items(), *grants])),
        *((license, "text", text) for license, text in texts.items()),
    ]

"""Standard licences as templates: whole texts from ``licenses/`` and the notices that name them.

A template is (licence, text, keys). One of the keys, a phrase of the text that its
sibling licences do not have, must stand in a passage unbroken.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

Template = tuple[str, str, tuple[str, ...]]

# Phrases of the whole texts.
BODIES = {
    "0BSD": ("with or without fee is hereby granted. THE SOFTWARE IS PROVIDED",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0", "each Contributor hereby grants to You a perpetual"),
    "Artistic-1.0": ('The "Artistic License"', "semblance of artistic control over the development"),
    "BSD-2-Clause": ("Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice"),
    "BSD-3-Clause": ("endorse or promote products derived from this software", "without specific prior written permission"),
    "BSD-4-Clause": ("All advertising materials mentioning features or use of this software",),
    "BSL-1.0": ("Boost Software License - Version 1.0", "the software and accompanying documentation covered by this license"),
    "CC-BY-SA-3.0": ("Attribution-ShareAlike 3.0 Unported", "Attribution, ShareAlike"),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0 International Public License",),
    "CC0-1.0": ("CC0 1.0 Universal", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    "EPL-1.0": ("Eclipse Public License - v 1.0",),
    "EPL-2.0": ("Eclipse Public License - v 2.0", '"Secondary License" means either the GNU General Public License'),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3", "Massive Multiauthor Collaboration Site"),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2", "any portion of it, thus forming a work based on the Program"),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3", '"This License" refers to version 3 of the GNU General Public License'),
    "ISC": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3"),
    "MIT": ("The above copyright notice and this permission notice shall be included", "shall be included in all copies or substantial portions of the Software"),
    "MIT-0": ("to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED",),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0"),
    "OFL-1.1": ("SIL OPEN FONT LICENSE Version 1.1",),
    "Unicode-3.0": ("UNICODE LICENSE V3",),
    "Unlicense": ("free and unencumbered software released into the public domain", "relinquishment in perpetuity of all present and future rights"),
    "Zlib": ("Altered source versions must be plainly marked as such",),
}
# Where a text ends for those that leave out how it is applied.
END = "END OF TERMS AND CONDITIONS"

# Names by which texts state their licence.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "0BSD": ("0BSD License", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD": ("BSD License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License v. 1.0", "Eclipse Public License 1.0", "Eclipse Public License, version 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "ISC": ("ISC License",),
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    **{f"MPL-{v}": (f"Mozilla Public License, v. {v}", f"Mozilla Public License {v}", f"Mozilla Public License, version {v}", f"MPL {v}") for v in ("1.0", "1.1", "2.0")},
    **{f"GFDL-{v}": (f"GNU Free Documentation License, Version {v}", f"GNU FDL {v}") for v in ("1.1", "1.2", "1.3")},
}
# Letter, word before "General Public License" and versions.
GNU = (("", "", ("1", "2", "3")), ("L", "Library ", ("2",)), ("L", "Lesser ", ("2.1", "3")), ("A", "Affero ", ("3",)))
COMMONS = {
    "BY": ("Attribution",),
    "BY-SA": ("Attribution-ShareAlike", "Attribution-Share Alike"),
    "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works"),
    "BY-NC": ("Attribution-NonCommercial", "Attribution-Noncommercial", "Attribution-Non-Commercial"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-Share Alike", "Attribution-Non-Commercial-ShareAlike"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Non-Commercial-NoDerivatives"),
}
SIGNED = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "under the terms of the {}")
PLAIN = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "This work is licensed under a {}", "This work is licensed under the {}")

# Sentences that licences prescribe, with what tells them from their siblings.
SENTENCES: list[Template] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache.org/licenses/LICENSE-2.0",)),
    ("MIT", "Released under the MIT License", ("the MIT License",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("this software and associated documentation files",)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License, version 3",)),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("the GNU General Public License",)),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms", "the following conditions are met")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("this software for any purpose with or without fee is hereby granted",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License, v. 2.0",)),
    *[("EPL-" + v, f"This program and the accompanying materials are made available under the terms of the {name}", (name,)) for v in ("1.0", "2.0") for name in NAMES["EPL-" + v]],
]


def _gnu() -> list[Template]:
    out = []
    for letter, kind, versions in GNU:
        name = f"GNU {kind}General Public License"
        for what in ("program", "library"):
            free = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
            out.append((f"{letter}GPL", free, (f"the {name}",)))
            for v in versions:
                label = f"{letter}GPL-{v if '.' in v else v + '.0'}"
                key = f"the Free Software Foundation; {{}} {v} of the License"
                forms = [(f"{free}; {way} {v} of the License", key.format(way)) for way in ("version", "either version")]
                forms = [(f, (f"{name} as published by {k}",)) for f, k in forms]
                out += [(label, f, k) for f, k in forms] + [(label, f + ", or (at your option) any later version", k) for f, k in forms]
        for v in versions:
            label, whole = f"{letter}GPL-{v if '.' in v else v + '.0'}", v if "." in v else v + ".0"
            short = f"{letter}GPL"
            said = [f"{name}{mark}{n}" for mark in (", version ", " v", " v. ", " ") for n in {v, whole}]
            said += [f"{name} ({short}) {mark}{n}" for mark in ("version ", "v", "") for n in {v, whole}]
            said += [f"{gnu}{short}{mark}{n}" for gnu in ("GNU ", "") for mark in ("v", " v", " version ", " ") for n in {v, whole}]
            out += [(label, frame.format(s), (_key(s),)) for s in said for frame in SIGNED]
    return out


def _key(name: str) -> str:
    """A short name counts with the article only, as other words before it make it another name."""
    return name if len(name.split()) > 2 else f"the {name}"


def _commons() -> list[Template]:
    out = []
    for code, longs in COMMONS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for name in (f"CC {code} {v}", *[f"Creative Commons {x} {v}" for x in longs]):
                out += [(f"CC-{code}-{v}", frame.format(name), (name,)) for frame in PLAIN]
    return out


def _words(text: str) -> str:
    return f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "


@cache
def bodies() -> tuple[Template, ...]:
    """The whole texts, and those with instructions at their end without these as well."""
    out: list[Template] = []
    for name, keys in BODIES.items():
        text = (resources.files("corpuswarden.llm") / "licenses" / f"{name}.txt").read_text(encoding="utf-8")
        out.append((name, text, keys))
        if END in text:
            cut = text[: text.index(END) + len(END)]
            out.append((name, cut, tuple(k for k in keys if _words(k) in _words(cut))))
    return tuple(out)


@cache
def standard() -> tuple[Template, ...]:
    """All templates: sentences, named licences and whole texts."""
    named = [(label, frame.format(n), (n if label == "CC0-1.0" else _key(n),)) for label, names in NAMES.items() for n in names for frame in (PLAIN if label == "CC0-1.0" else SIGNED)]
    return tuple(dict.fromkeys([*SENTENCES, *named, *_gnu(), *_commons(), *bodies()]))

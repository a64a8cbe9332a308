"""Texts and standard headers of common public licences, by SPDX name.

``TEXTS`` holds short licences whole and the standard headers of long ones (a long licence text repeats its header in its
appendix, where the paragraph is found); ``NAMES`` the names under which statements speak of a licence.
"""

from __future__ import annotations

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""

BSD_NOTICES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(licence: str, what: str, version: str, verb: str = "redistribute it and/or modify") -> str:
    """The standard header of the GNU licences."""
    return f"""This {what} is free software; you can {verb} it under the terms of the {licence} as published by the Free Software
Foundation; either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details.

You should have received a copy of the {licence} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


def _commons(name: str, code: str) -> str:
    """The notice of the Creative Commons licences."""
    return f"""This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license,
visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""


TEXTS = {
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{ISC_AS_IS}""",
    "AGPL-3.0": _gnu("GNU Affero General Public License", "program", "3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{BSD_OPENING}\n\n{BSD_NOTICES}\n\n{BSD_AS_IS}",
    "BSD-3-Clause": f"{BSD_OPENING}\n\n{BSD_NOTICES}\n\n{BSD_ENDORSEMENT}\n\n{BSD_AS_IS}",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.""",
    "CC-BY-4.0": _commons("Attribution", "by"),
    "CC-BY-NC-4.0": _commons("Attribution-NonCommercial", "by-nc"),
    "CC-BY-SA-4.0": _commons("Attribution-ShareAlike", "by-sa"),
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "GPL-2.0": _gnu("GNU General Public License", "program", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "program", "3"),
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

{ISC_AS_IS}""",
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "library", "2.1"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "library", "3"),
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{AS_IS}""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.""",
    "WTFPL": """This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can
redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by
Sam Hocevar. See http://www.wtfpl.net/ for more details.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

NAMES = {
    "0BSD": ("Zero-Clause BSD License",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0 license", "Creative Commons Attribution 4.0 license"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 license"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 license"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("zlib License",),
}
FORMS = ("Licensed under the {}.", "Released under the {}.")
#: A paragraph of a licence is a template of its own from so many words on.
PARAGRAPH_WORDS = 12


def templates() -> list[tuple[str, int, str]]:
    """(license, shared, text): whole texts, their paragraphs and short statements.

    ``shared`` is 1 for a paragraph that several licences have word for word; it names the first of them in alphabetical order
    and counts only where nothing else is found.
    """
    owners: dict[str, list[str]] = {}
    for name, text in sorted(TEXTS.items()):
        found = [text, *(p for p in text.split("\n\n") if len(p.split()) >= PARAGRAPH_WORDS)]
        for part in dict.fromkeys(" ".join(p.split()) for p in found):
            owners.setdefault(part, []).append(name)
    rows = [(names[0], int(len(names) > 1), part) for part, names in owners.items()]
    return rows + [(name, 0, form.format(called)) for name, names in sorted(NAMES.items()) for called in names for form in FORMS]

"""Templates of the license scan: public licence texts, standard headers and statements, by SPDX identifier."""

from __future__ import annotations

# The texts and notices of the licences.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_OPENING = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""

#: The family's name, its releases as (number, identifier, date of the text), and what its notices call the work.
_GNU = [
    ("GNU General Public License", [("2", "GPL-2.0", "June 1991"), ("3", "GPL-3.0", "29 June 2007")], "program"),
    ("GNU Lesser General Public License", [("2.1", "LGPL-2.1", "February 1999"), ("3", "LGPL-3.0", "29 June 2007")], "library"),
    ("GNU Affero General Public License", [("3", "AGPL-3.0", "19 November 2007")], "program"),
]
#: Creative Commons elements and their names.
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")]
_NAMED = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"), ("0BSD", "Zero-Clause BSD License"),
]


def templates() -> list[tuple[str, str]]:
    """(identifier, text): full texts, headers, and statements made from the licences' names."""
    out = [
        ("MIT", f"MIT License\n{_MIT_GRANT}\n{_MIT_NOTICE}\n{_WARRANTY}"), ("MIT", _MIT_GRANT),
        ("BSD-2-Clause", f"{_BSD_START}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD_START}\n{_BSD_THIRD}\n{_BSD_END}"), ("BSD-2-Clause", _BSD_START), ("BSD-3-Clause", f"{_BSD_START}\n{_BSD_THIRD}"),
        ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"), ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
        ("Apache-2.0", _APACHE_HEADER), ("Apache-2.0", _APACHE_OPENING), ("MPL-2.0", _MPL_HEADER), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("BSL-1.0", f"{_BOOST}\n{_WARRANTY}"),
        ("CC0-1.0", "dedicated to the public domain under CC0 1.0"), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ]
    for name, releases, work in _GNU:
        for number, spdx, date in releases:
            for later, clause in (("", f"version {number} of the License."), ("-or-later", f"either version {number} of the License, or (at your option) any later version.")):
                notice = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {clause}"
                rest = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
                out += [(spdx + later, notice), (spdx + later, f"{notice}\n{rest}")]
            out.append((spdx, f"{name} Version {number}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."))
            out += [(spdx, f"{lead} the {name}, version {number}") for lead in ("licensed under", "this work is licensed under", "released under")]
            out += [(f"{spdx}-or-later", f"licensed under the {name}, version {number} or any later version"), (spdx, f"SPDX-License-Identifier: {spdx}-only"), (f"{spdx}-or-later", f"SPDX-License-Identifier: {spdx}-or-later")]
    for spdx, name in _NAMED:
        out += [(spdx, f"{lead} the {name}") for lead in ("licensed under", "released under", "this work is licensed under")] + [(spdx, f"SPDX-License-Identifier: {spdx}")]
    for element, name in _CC:
        spdx = f"CC-{element}-4.0"
        out += [(spdx, f"Licensed under CC {element} 4.0"), (spdx, f"This work is licensed under a Creative Commons {name} 4.0 International License"), (spdx, f"SPDX-License-Identifier: {spdx}")]
    return out

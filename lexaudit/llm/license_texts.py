"""Licence notices, headers and texts that files are compared with (fixed values; public licence texts)."""

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: '
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BOOST = (
    'Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
    "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."
    )


def _gnu_title(name: str, version: str, date: str, year: str) -> str:
    return f"{name.upper()} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: (licence, text) of all that a line, a block of lines or a file is compared with.
TEMPLATES = [
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", _gnu(_AGPL, "3")),
    ("agpl-3.0", _gnu_title(_AGPL, "3", "19 November 2007", "2007")),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", _BOOST),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", _gnu(_GPL, "2")),
    ("gpl-2.0", _gnu_title(_GPL, "2", "June 1991", "1989, 1991")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _gnu(_GPL, "3")),
    ("gpl-3.0", _gnu_title(_GPL, "3", "29 June 2007", "2007")),
    ("isc", "Released under the ISC License."),
    ("isc", _ISC),
    ("lgpl-2.1", _gnu(_LGPL, "2.1")),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", _gnu(_LGPL, "3")),
    ("lgpl-3.0", _gnu_title(_LGPL, "3", "29 June 2007", "2007")),
    ("mit", "Released under the MIT License."),
    ("mit", "The MIT License (MIT)"),
    ("mit", _MIT),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Released into the public domain under the Unlicense."),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB),
    # the tag that names a licence by its SPDX identifier
    *(
        (k, f"SPDX-License-Identifier: {name}")
        for k, name in (
            ("agpl-3.0", "AGPL-3.0-or-later"), ("agpl-3.0", "AGPL-3.0-only"), ("apache-2.0", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("bsl-1.0", "BSL-1.0"),
            ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc0-1.0", "CC0-1.0"), ("epl-2.0", "EPL-2.0"), ("gpl-2.0", "GPL-2.0-only"), ("gpl-2.0", "GPL-2.0-or-later"),
            ("gpl-3.0", "GPL-3.0-only"), ("gpl-3.0", "GPL-3.0-or-later"), ("isc", "ISC"), ("lgpl-2.1", "LGPL-2.1-or-later"), ("lgpl-3.0", "LGPL-3.0-or-later"), ("mit", "MIT"), ("mpl-2.0", "MPL-2.0"), ("unlicense", "Unlicense"), ("zlib", "Zlib"),
        )
    ),
]

#: Words of the templates that any prose holds; they are the last to be asked for.
PLAIN_WORDS = frozenset(
    "1 2 3 4 a above act action additional after agreed all along an and any anyone appear are arising as at author authors available be being benefit binary but by can caused changing charge claim code commercial common compliance conditions connection "
    "copies copy damage damages data deal dealings details direct display distribute distributed document documentation either entire even event every everyone except execute express extent fee file files fitness following for form forms founded free freely from full "
    "further future general generated granted have held hereby high hope if in inc including information interest is it its january june kind language large later law laws liability library license licensed limitation limitations limited list loss "
    "made make march marked material materials may means merge met modify more must name names neither no nor not notice november object obtain obtaining of on one only option or order organization origin original other otherwise our out part particular "
    "performance permission permit permitted person persons possibility possible prepare present prior product products profits program project promote provided public publish published purpose received recognize redistribute regard related released removed "
    "reproduce required reserved resulting retain rights see sell services shall should so software solely source special specific statement strict subject substantial such terms that the their theory third this those to under universal unless use used useful version "
    "was way we whether which who whole whom will with without work works would writing written wrote you your".split()
)

#: Of those, the words that hardly any text is without.
FUNCTION_WORDS = frozenset("1 2 3 4 a above after all along an and any are as at be being but by can do for from full has have how if in is it its large later made make may means more must no not of on one only or other our out part person see should so such that the their this those to under use used was way we which who whole will with without work would you your".split())

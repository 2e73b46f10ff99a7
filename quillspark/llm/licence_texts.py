"""Public licence texts, notices and digests that scans know. Fixed values, in plain order.

Short texts are given in full, with the wordings and titles in use; long ones by the digest
of their canonical form (``licences.canonical``), taken from the public text files that
Linux distributions ship under these names.
"""

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_MIT_TERMS = """, subject to the following conditions:

The above copyright notice and this permission notice{next} shall be included in all copies or substantial portions of the Software.
"""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = {
    "holder": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "holders": "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
}

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Who disclaims, and who is not liable.
_BSD_PARTIES = [
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
    ("AUTHORS AND CONTRIBUTORS", "THE AUTHORS OR CONTRIBUTORS"),
    ("AUTHOR", "THE AUTHOR"),
]

#: Marks of the numbered conditions, as canonical words: numbers, letters, or bullets (none).
_BSD_MARKS = [("1.", "2.", "3."), ("a.", "b.", "c."), ("", "", "")]

_ISC_GRANT = """Permission to use, copy, modify, {and_or} distribute this software for any purpose with or without fee is hereby granted"""

_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

{0} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
{1} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
{2} This notice may not be removed or altered from any source distribution."""

#: Licence -> full texts, in all known wordings, without title and copyright lines.
TEXTS = {
    "MIT": [_MIT_GRANT + _MIT_TERMS.format(next=n) + _NO_WARRANTY.format(who=w) for n in ("", " (including the next paragraph)") for w in ("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS", "THE COPYRIGHT HOLDERS")],
    "MIT-0": [_MIT_GRANT + ".\n\n" + _NO_WARRANTY.format(who="THE AUTHORS OR COPYRIGHT HOLDERS")],
    "BSD-2-Clause": [_BSD_HEAD.format(*m) + "\n" + _BSD_TAIL.format(by=by, liable=li) for m in _BSD_MARKS for by, li in _BSD_PARTIES],
    "BSD-3-Clause": [_BSD_HEAD.format(*m) + f"\n{m[2]} {third}\n\n" + _BSD_TAIL.format(by=by, liable=li) for m in _BSD_MARKS for third in _BSD_THIRD.values() for by, li in _BSD_PARTIES],
    "ISC": [_ISC_GRANT.format(and_or=a) + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL.format(who=w) for a in ("and/or", "and") for w in ("THE AUTHOR", "ISC")],
    "0BSD": [_ISC_GRANT.format(and_or="and/or") + ".\n\n" + _ISC_TAIL.format(who="THE AUTHOR")],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"],
    "BSL-1.0": [_BOOST],
    "Zlib": [_ZLIB.format(*m) for m in (("1.", "2.", "3."), ("", "", ""))],
}

#: Titles that may stand before a full text (the copyright lines between are no part of the canonical form).
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT-0", "MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License", "The BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "BSD-0-Clause"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License - Version 1.0"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
}

#: Licence -> digests of the canonical forms of its long text: the whole file, and the file up to "END OF TERMS AND CONDITIONS" where it has more after that.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"],
    "Artistic-1.0-Perl": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
    "CC0-1.0": ["96f9b6f44f60a039539ef5cba12c6d4365c81621ff3a06ac37a3db1d5c225621"],
    "GFDL-1.2": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"],
    "MPL-2.0": ["9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"],
}

NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "This project is licensed under the Apache License 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "GPL-2.0": ["Licensed under the GNU General Public License, Version 2."],
    "GPL-3.0": ["Licensed under the GNU General Public License, Version 3.", "This work is licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, Version 2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, Version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, Version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["Released into the public domain under the Unlicense."],
}

#: SPDX identifiers named in one line, by licence.
SPDX = {
    "MIT": ["MIT"], "MIT-0": ["MIT-0"], "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "ISC": ["ISC"], "0BSD": ["0BSD"], "Unlicense": ["Unlicense"], "BSL-1.0": ["BSL-1.0"],
    "Zlib": ["Zlib"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "MPL-2.0": ["MPL-2.0"], "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
}

#: Spellings that count as one, as whole words: found -> kept.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations", "merchantibility": "merchantability", "http": "https",
    "acknowledgement": "acknowledgment", "authorised": "authorized", "recognise": "recognize", "judgement": "judgment", "favour": "favor", "honour": "honor", "labour": "labor", "programme": "program", "whilst": "while",
    "wilful": "willful", "fulfil": "fulfill", "centre": "center", "analogue": "analog", "cancelled": "canceled", "utilisation": "utilization", "owner": "holder", "owners": "holders",
}

#: Phrases that count as one, after the words above: found -> kept (nothing: no part of the canonical form).
PHRASES = {"non infringement": "noninfringement", "sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent", "all rights reserved": ""}


def known() -> list[tuple[str, str, str, str]]:
    """Licence, kind (text, notice), text and digest, one of the last two empty, of all that is known."""
    out = [(k, "text", t, "") for k, ts in TEXTS.items() for t in ts]
    out += [(k, "text", f"{title}\n\n{t}", "") for k, ts in TEXTS.items() for t in ts for title in TITLES[k]]
    out += [(k, "text", "", d) for k, ds in DIGESTS.items() for d in ds]
    out += [(k, "notice", t, "") for k, ts in NOTICES.items() for t in ts]
    return out + [(k, "notice", f"SPDX-License-Identifier: {i}", "") for k, ids in SPDX.items() for i in ids]

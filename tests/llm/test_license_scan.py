from __future__ import annotations

import re

from tollgate.llm.license_scan import CUE, RULES, SAID, SENTENCES, scan_licences, variants

MIT = f"x.\nThe MIT License (MIT)\n\n{SENTENCES['mit-grant']}:\n\n{SENTENCES['mit-notice']}."
BSD2 = ". ".join(SENTENCES[f"bsd-{s}"] for s in ("redistribution", "source", "binary")) + "."
BSD3 = f"{BSD2} {SENTENCES['bsd-endorse']}!"


def test_known_texts(spark):
    wrapped = MIT.replace("publish, ", "publish,\n   ")
    rows = [
        (1, MIT, 3, "MIT"), (2, wrapped, 3, "MIT"), (3, BSD2, 3, "BSD-2-Clause"), (4, BSD3, 4, "BSD-3-Clause"),
        (5, "Licensed under CC BY-NC 4.0.\nLICENSED under the apache license, version 2.0", 2, "Apache-2.0,CC-BY-NC-4.0"),
        (6, "He was licensed to drive. No permission.", 0, ""),
        (7, "no stop before\nReleased under the MIT License\nno stop after", 0, "MIT"),
        (8, SENTENCES["bsd-source"] + ".", 1, ""),
        (9, "lorem. " * 20_000 + SENTENCES["mit-under"] + ".", 1, "MIT"),
    ]
    found = scan_licences(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(a, n, names) for a, _, n, names in rows}


def test_odd_rows_have_no_licence(odd_docs, odd_texts):
    rows = scan_licences(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 4
    assert {(r.n_known, r.licences) for r in rows} == {(0, "")}


def test_no_rows(no_docs):
    assert scan_licences(no_docs).count() == 0


def test_rules_name_known_sentences():
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES) | set(SAID)
    assert all(re.search(CUE, s) for _, s in variants())


def test_plan_is_native(odd_docs):
    plan = scan_licences(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_notices_written_out(spark):
    """Notices as they stand in files, not taken from the table."""
    rows = [
        ("Some text.\nAll rights reserved.", 1, "LicenseRef-all-rights-reserved"),
        ("Copyright 2020 A. All Rights Reserved.", 1, "LicenseRef-all-rights-reserved"),
        ("// SPDX-License-Identifier: MIT\nint x", 1, "MIT"),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later\n\nx", 2, "LGPL-2.1-or-later"),
        ("MIT. ISC.", 2, ""),
        ("This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General "
         "Public\n License as published by the Free Software Foundation; either\n version 2.1 of the License, or (at your "
         "option) any later version.", 2, "LGPL-2.1-or-later"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
         "License version 2 as published by the Free Software Foundation.", 1, "GPL-2.0-only"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
         "any later version.", 1, "AGPL-3.0-or-later"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was "
         "not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", 2, "MPL-2.0"),
        ("This work is marked with CC0 1.0 Universal.", 1, "CC0-1.0"),
        ("This is free and unencumbered software released into the public domain.", 1, "Unlicense"),
        ("This work is licensed under CC BY-NC-ND 4.0.", 1, "CC-BY-NC-ND-4.0"),
        # known sentences that do not stand together make no sequence
        ("SPDX-License-Identifier: see the file NOTICE. It was new. MIT. That is a school.", 2, ""),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\n", 2, "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later OR EPL-2.0)\n\ncode", 2, "EPL-2.0,GPL-2.0-or-later"),
        ("SPDX-License-Identifier: MIT OR Whatever\n", 1, ""),
        ("// SPDX-License-Identifier: EPL-2.0\n\nx", 2, "EPL-2.0"),
        ("SPDX-License-Identifier: 0BSD\n", 2, "0BSD"),
        ("Released under the Eclipse Public License 2.0.", 1, "EPL-2.0"),
        ("Apache License 2.0", 1, "Apache-2.0"),
        ("This project is licensed under the Apache License 2.0.", 1, "Apache-2.0"),
        ("Copyright 2021 B.\n\nAll rights reserved worldwide.", 1, "LicenseRef-all-rights-reserved"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
         "following conditions are met:\n\n 1. Redistributions of source code must retain the above copyright notice, this\n"
         "list of conditions and the following disclaimer.\n 2. Redistributions in binary form must reproduce the above "
         "copyright notice,\nthis list of conditions and the following disclaimer in the documentation and/or\nother materials "
         "provided with the distribution.\n", 3, "BSD-2-Clause"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
         "following conditions are met: none so far. Redistributions of source code must retain the above copyright notice, "
         "this list of conditions and the following disclaimer.", 2, ""),
    ]
    docs = [(i, text) for i, (text, _, _) in enumerate(rows)]
    found = scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == {(i, n, names) for i, (_, n, names) in enumerate(rows)}

"""Notices that are wrapped over lines."""

import pytest

from terragrid.llm import license

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"


def marked(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


@pytest.mark.parametrize("mark", ["#", "//", " *", "--", "rem", ""])
def test_wrapped_notices(spark, mark):
    rest = "\n* Redistributions must retain the notice above and this list\n\nimport os\n"
    rows = [
        (0, "LICENSE", "Licensed under CC BY 4.0."),
        (1, "a/1.py", marked("Copyright (c) 2020 Some One\n" + BSD, mark) + rest),
        (2, "a/2.py", marked("A module of ours.\n\n" + BSD, mark).replace("\n", "\r\n") + rest),
        (3, "a/3.c", marked("Copyright 2020 Some One. All rights reserved.\n\n" + MIT, mark) + "\n\nint x;\n"),
        (4, "a/4.py", marked("This work is licensed under the GNU General\nPublic License, version 3.", mark) + "\nx = 1\n"),
        (5, "a/5.py", marked("Redistribution and use in source\n\nof text and sounds that are permitted", mark)),
        (6, "a/6.py", marked(MIT.split("\n")[0], mark) + "\n\n" + "\n" * 20_000 + MIT.split("\n")[4]),
    ]
    got = {r["file_id"]: (r["stated"], r["licence"]) for r in license.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    own = {0: "CC-BY-4.0", 1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "MIT", 4: "GPL-3.0", 5: None, 6: None}
    assert got == {k: (v, v or "CC-BY-4.0") for k, v in own.items()}

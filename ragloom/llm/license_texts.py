"""License wordings in template markup. Public license texts, short ones here,
whole ones in the files of ``license_templates`` (name of the license: name of the file).

<<beginOptional>> ... <<endOptional>> may be left out; <<var;words=a-b>> stands for
a to b words of any kind.
"""

from importlib.resources import files

TEMPLATES = {
    "gpl-notice": """<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> licensed under
        <<beginOptional>>the terms of<<endOptional>> the GNU General Public License
        <<beginOptional>>version <<var;words=1-1>><<endOptional>>""",
    "apache-2.0-notice": """licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2 0
        <<beginOptional>>the License you may not use <<var;words=1-4>> except in compliance with the License
        <<endOptional>>""",
    "mit-notice": """<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> released under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "cc-by-notice": """licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>>
        <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4 0
        <<beginOptional>>international<<endOptional>>""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;words=1-6>> and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.<<endOptional>>""",
    "isc-text": """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or
        <<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<var;words=0-1>> Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
}


def whole_texts() -> dict[str, str]:
    """label -> markup of the whole license texts that come with the package."""
    folder = files(__package__).joinpath("license_templates")
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name)
            if f.name.endswith(".txt")}


TEMPLATES |= whole_texts()

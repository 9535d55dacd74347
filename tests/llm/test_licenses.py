"""License scan: short sentences in long lines, several licenses side by side, wrapped notices."""

import random
import textwrap

import pytest

from zonetide.llm import licenses

PROSE = ("the harbour was quiet that morning and nobody who walked along it would have guessed what the "
         "storm had done to boats farther out where old men still fished with nets their fathers made ")


def places(text):
    """(start, end, license) of each row of one text."""
    return sorted((r[0], r[1], r[2]) for r in licenses.Scanner(licenses.TEMPLATES).find(text.lower().encode()))


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_a_sentence_inside_a_long_line_is_found(name):
    wording = licenses.TEMPLATES[name]
    for around in (0, 60, 140, 600, 3000):
        side = (PROSE * 20)[:around].rsplit(" ", 1)[0]
        text = f"{side} {wording} {side}"
        assert [x[2] for x in places(text)] == [name]
        start, end, _ = places(text)[0]
        assert start == len(side) + 1 and wording.startswith(text[start:end])


def test_short_sentences_inside_long_lines_of_documents(documents):
    docs = documents([f"{PROSE * 3}{licenses.TEMPLATES[name]} {PROSE * 3}" for name in licenses.TEMPLATES])
    rows = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    assert rows.keys() == set(enumerate(licenses.TEMPLATES))
    assert all(r.matched == 1.0 and r["rank"] == 1 and r.added == 0 for r in rows.values())


@pytest.mark.parametrize("one", licenses.TEMPLATES)
def test_neighbouring_licenses_and_copies_are_all_found(one):
    for other in licenses.TEMPLATES:
        for between in ("\n", " ", "\n\n"):
            text = between.join(licenses.TEMPLATES[name] for name in (one, other, one))
            assert [x[2] for x in places(text)] == [one, other, one], (other, between)


def test_all_licenses_in_one_block_and_copies_in_a_document(documents):
    every = list(licenses.TEMPLATES.values())
    rows = licenses.scan(documents(["\n".join(every), " ".join(every[::-1]), f"{licenses.TEMPLATES['Apache-2.0']}\n" * 2])).collect()
    names = [[r.license for r in sorted(rows, key=lambda r: r.start) if r.doc_id == i] for i in range(3)]
    assert names == [list(licenses.TEMPLATES), list(licenses.TEMPLATES)[::-1], ["Apache-2.0"] * 2]
    assert all(r.matched == 1.0 and r.added == 0 for r in rows)


def test_a_changed_notice_is_no_short_one():
    notice = licenses.TEMPLATES["Apache-2.0-notice"].replace("except", "unless")
    found, = licenses.Scanner(licenses.TEMPLATES).find(notice.lower().encode())
    assert found[2] == "Apache-2.0-notice" and found[6:] == ("except", 1)


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_wrapped_notices_are_found_whole(name):
    wording = licenses.TEMPLATES[name]
    for width, sign in ((72, ""), (40, ""), (20, ""), (60, "# "), (50, "     * "), (30, "// é ")):
        text = f"{PROSE}\n\n{textwrap.indent(textwrap.fill(wording, width), sign)}\n\n{PROSE}"
        (start, end, found), = places(text)
        assert found == name
        assert text.encode()[start:end].decode().split()[0] == wording.split()[0]


def test_wrapped_notices_of_documents(documents):
    docs = documents([f"{PROSE}\n{textwrap.fill(t, 72)}\n{PROSE}\n{textwrap.fill(t, 50)}\n" for t in licenses.TEMPLATES.values()])
    rows = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == sorted(list(enumerate(licenses.TEMPLATES)) * 2)
    assert all(r.matched == 1.0 and r.missing == "" and r.added == 0 for r in rows)


def test_bytes_that_are_no_utf8():
    text = b"\xff\xe9 " * 50 + licenses.TEMPLATES["MIT"].lower().encode()
    assert [r[:3] for r in licenses.Scanner(licenses.TEMPLATES).find(text)] == [(150, len(text) - 1, "MIT")]


def test_words_that_are_added_do_not_hide_a_license():
    text = b"all cgglmlmjed lfnkaleagk rights clolm imlfcdml reserved"
    assert [(r[2], r[5], r[7]) for r in licenses.Scanner(licenses.TEMPLATES).find(text + b" (licensed)")] == [
        ("all-rights-reserved", 1.0, 4)]


class Constant:
    """A compressor that says nothing about its input."""

    def compress(self, data):
        return b"x" * 40


def test_without_compression_nothing_is_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = PROSE.encode() + licenses.TEMPLATES["MIT"].lower().encode()
    assert [r[2] for r in scanner.find(text)] == ["MIT"]
    scanner.known.clear()
    scanner.plain, scanner.given = Constant(), dict.fromkeys(scanner.given, Constant())
    assert scanner.find(text) == []


def test_templates_of_ones_own_are_found_by_their_own_cues(documents):
    own = {"zebra": "zebra crossing grants every walker passage", "stop": "of the and to it", "empty": " - "}
    rows = licenses.scan(documents([f"{PROSE} Zebra crossing, grants every walker passage {PROSE}", "x of the and to it y"]), own).collect()
    assert [(r.doc_id, r.license, r.matched) for r in rows] == [(0, "zebra", 1.0), (1, "stop", 1.0)]


class EveryWindow(licenses.Scanner):
    """Every window of every template, whatever words it holds."""

    def ranked(self, words, known):
        text, found = [b"\0" if w is None else w for w in words], []
        for name, wording in self.wording.items():
            for first in range(len(words)):
                end = min(first + wording.window, len(words))
                window = b" ".join(text[first:end]) + licenses.FILLER
                plain = len(self.plain.compress(window))
                saved = plain - len(self.given[name].compress(window))
                if saved >= self.least[name]:
                    found.append((saved, saved / plain, name, first, end))
        return sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3]))


def test_as_by_every_window_of_every_template():
    random.seed(4)
    plain, full = licenses.Scanner(licenses.TEMPLATES), EveryWindow(licenses.TEMPLATES)
    filler = [w.encode() for w in PROSE.split()]
    same = count = 0
    for _ in range(60):
        words = [random.choice(filler) for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(1, 3)):
            wording = list(plain.wording[random.choice(list(plain.wording))].words)
            for _ in range(random.randint(0, max(1, len(wording) // 8))):  # words put in, left out or changed
                at = random.randrange(len(wording))
                wording[at:at + random.randint(0, 1)] = [random.choice(filler)] * random.randint(0, 1)
            words += wording + [random.choice(filler) for _ in range(random.randint(0, 30))]
        one, other = ([(r[0], r[1], r[2]) for r in s.scan(words)] for s in (plain, full))
        same, count = same + len(set(one) & set(other)), count + len(set(one) | set(other))
    assert same == count > 60

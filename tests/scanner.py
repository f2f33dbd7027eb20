"""Slow character-by-character classifier, written for tests only."""

from linescope.operators.languages import LANGUAGES

LEXICON = {lang.name: lang.lexicon for lang in LANGUAGES}
SPACES = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


def physical_lines(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def strip(line):
    return line.strip("".join(SPACES))


def docstring_lines(lines):
    found, stack, pending, active = set(), [[0, True]], None, None
    for n, line in enumerate(lines):
        bare = strip(line)
        indent = 0
        while indent < len(line) and line[indent] in SPACES:
            indent += 1
        if active:
            found.add(n)
            if active in bare:
                active = None
            continue
        if not bare or bare[0] == "#":
            continue
        while len(stack) > 1 and indent < stack[-1][0]:
            stack.pop()
        if pending is not None:
            if indent > pending:
                stack.append([indent, True])
                pending = None
            elif bare[0] != "@":
                pending = None
        expected, stack[-1][1] = stack[-1][1], False
        if expected:
            rest = bare.lstrip("rRuUbBfF")
            if rest[:3] in ('"""', "'''"):
                found.add(n)
                if bare.count(rest[:3]) < 2:
                    active = rest[:3]
                continue
        if bare.startswith(("def ", "async def ", "class ")) and bare.endswith(":"):
            pending = indent
    return found


def scan(language, text):
    """(codes, unclosed_block, unclosed_string)"""
    rule = LEXICON[language]
    lines = physical_lines(text)
    docs = docstring_lines(lines) if language == "Python" else set()
    state, codes = None, ""
    for n, line in enumerate(lines):
        if n in docs:
            codes += "D"
            continue
        code = single = False
        multi = state == "block"
        i = 0
        while i < len(line):
            here = line[i:]
            if state == "block":
                multi = True
                if here.startswith(rule.block[1]):
                    state, i = None, i + len(rule.block[1])
                else:
                    i += 1
            elif state == "verbatim":
                code = True
                if here.startswith('""'):
                    i += 2
                else:
                    state, i = (None if here[0] == '"' else state), i + 1
            elif state in ('"""', "'''"):
                code = True
                if here.startswith(state):
                    state, i = None, i + 3
                else:
                    i += 1
            elif state:
                code = True
                if here[0] == "\\":
                    i += 2
                else:
                    state, i = (None if here[0] == state else state), i + 1
            elif here[0] in SPACES:
                i += 1
            elif "v" in rule.quotes and here.startswith('@"'):
                code, state, i = True, "verbatim", i + 2
            elif "t" in rule.quotes and here[:3] in ('"""', "'''"):
                code, state, i = True, here[:3], i + 3
            elif ("q" in rule.quotes and here[0] == "'") or ("d" in rule.quotes and here[0] == '"'):
                code, state, i = True, here[0], i + 1
            elif rule.block and here.startswith(rule.block[0]):
                multi, state, i = True, "block", i + len(rule.block[0])
            elif any(here.startswith(p) for p in rule.line):
                single = True
                break
            else:
                code, i = True, i + 1
        if code:
            codes += "X" if single else "Y" if multi else "C"
        else:
            codes += "S" if single else "M" if multi else " "
    return codes, state == "block", state not in (None, "block")

"""Short plain-Python statement of the packing rules, for small random inputs."""

from __future__ import annotations

from arborlake.functions.lines import WHITE_SPACE


def split_lines(text: str) -> list[str]:
    parts = text.replace("\r\n", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def size(text: str) -> int:
    return len(text.encode())


def head(text: str, n: int) -> tuple[str, int]:
    rows = split_lines(text)
    return (text, 0) if n >= len(rows) else ("\n".join(rows[:n]), len(rows) - n)


def depth_of(line: str) -> int:
    body = line.lstrip(WHITE_SPACE)
    return size(line) - size(body) if body else 0


def fold(text: str, depth: int) -> tuple[str, int]:
    out, left_out, run = [], 0, 0
    for line in [*split_lines(text), None]:
        hidden = line is not None and depth_of(line) > depth
        if hidden:
            run += 1
            continue
        if run:
            out.append(f"... ({run} lines)")
            left_out += run
            run = 0
        if line is not None:
            out.append(line)
    result = ""
    for piece in out:
        result += ("\n" if result else "") + piece
    return result, left_out


def best_head(texts: list[str], budget: int) -> int:
    longest = max((len(split_lines(t)) for t in texts), default=0)
    fitting = [n for n in range(longest + 1) if sum(size(head(t, n)[0]) for t in texts) <= budget]
    return max(fitting, default=0)


def best_depth(texts: list[str], budget: int) -> int | None:
    deepest = max((depth_of(row) for t in texts for row in split_lines(t)), default=0)
    fitting = [d for d in range(deepest + 1) if sum(size(fold(t, d)[0]) for t in texts) <= budget]
    return max(fitting, default=None)


def pack(texts: list[str], budget: int, mode: str) -> tuple[str, int | None, list[tuple[str, int]]]:
    if sum(map(size, texts)) <= budget:
        return "full", None, [(t, 0) for t in texts]
    if mode == "nest":
        depth = best_depth(texts, budget)
        if depth is not None:
            return "nest", depth, [fold(t, depth) for t in texts]
    n = best_head(texts, budget)
    return "head", n, [head(t, n) for t in texts]

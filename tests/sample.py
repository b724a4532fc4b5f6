"""A CSF text retyped for the tests: header and records given as numbers, rendered on the fixed grid."""

# The peel list, header, records and descriptors that a description must reproduce.
PEEL = "5s 4d- 4d 5p- 5p 6s 4f- 4f 5d- 5d 6p- 6p 7s 5f- 5f 6d- 6d 7p- 7p 8s 5g- 5g 6f- 6f 7d- 7d 8p- 8p 9s".split()
HEADER = ["Core subshells:", "  1s   2s   2p-  2p", "Peel subshells:", "  " + "  ".join(PEEL), "CSF(s):"]
CORE = [("5s", 2), ("4d-", 4), ("4d", 6), ("5p-", 2), ("5p", 4), ("6s", 2)]


def record(blocks, middle=None, coupled=None, final="4-"):
    """Three lines of (name, electrons) blocks with J texts by block number."""
    middle, coupled = middle or {}, coupled or {}
    line1 = "".join(f"{(n if n.endswith('-') else n + ' '):>5}({e:>2})" for n, e in blocks)
    line2 = "".join(f"{middle.get(i, ''):>9}" for i in range(len(blocks)))
    line3 = "    " + "".join(f"{coupled.get(i, ''):>9}" for i in range(len(blocks) - 1)) + f"{final:>7}"
    return line1, line2, line3


RECORDS = [
    record([*CORE, ("4f-", 3), ("4f", 4), ("5d-", 1)], {6: "9/2", 7: "8", 8: "3/2"}, {7: "7/2"}),
    record([*CORE, ("4f-", 6), ("4f", 1), ("5d-", 1)], {7: "7/2", 8: "3/2"}),
    record([*CORE, ("4f-", 3), ("4f", 4), ("5d-", 1)], {6: "3/2", 7: "4;   4", 8: "3/2"}, {7: "7/2"}),
    record([*CORE, ("4f-", 3), ("4f", 4), ("5d-", 1)], {6: "5/2", 7: "2;   4", 8: "3/2"}, {7: "7/2"}),
]
RAW = [[3, 9, 9, 4, 16, 7, 1, 3, 8], [6, 0, 0, 1, 7, 7, 1, 3, 8], [3, 3, 3, 4, 8, 7, 1, 3, 8], [3, 5, 5, 4, 8, 7, 1, 3, 8]]
NORMAL = [
    [0.5, 1, 1, 0.5, 1, 7 / 11, 0.25, 1, 1],
    [1, 0, 0, 0.125, 1, 1, 0.25, 1, 1],
    [0.5, 1 / 3, 1 / 3, 0.5, 0.5, 7 / 11, 0.25, 1, 1],
    [0.5, 5 / 9, 5 / 9, 0.5, 0.5, 7 / 11, 0.25, 1, 1],
]


def text(records=RECORDS, end="\n"):
    return end.join([*HEADER, *(line for r in records for line in r)]) + end

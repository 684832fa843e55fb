"""Fixed values of the formats that prepared corpora and samples follow."""

# Special token ids of the first protocol and of control tokens of the second.
PAD, UNK, BOS, EOS = 0, 1, 2, 3
SYSTEM, USER, ASSISTANT, END, THINK, END_THINK = 4, 5, 6, 7, 8, 9
TOOL_LIST, TOOL_CALL, TOOL_RESULT, END_TOOL, CODE, END_CODE = 10, 11, 12, 13, 14, 15
CONTROL_TOKENS = {
    "<system>": 4, "<user>": 5, "<assistant>": 6, "<end>": 7, "<think>": 8, "</think>": 9,
    "<tool_list>": 10, "<tool_call>": 11, "<tool_result>": 12, "</tool>": 13, "<code>": 14, "</code>": 15,
}
RESERVED = 32
STOP_IDS = (3, 7)
FORBIDDEN_IDS = (0, 1, 2, 12)
IGNORE = -100
MAX_FIELD_CHARS = 32_000
TOKEN_MAX = 65_535

# The 29 code points that count as white space.
WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))

# Text around the parts of a sample.
INSTRUCTION_HEAD = "### Instruction:\n"
INPUT_HEAD = "\n\n### Input:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
USER_HEAD = "### User:\n"
ASSISTANT_HEAD = "### Assistant:\n"
SYSTEM_HEAD = "System: "
LATER_SYSTEM_HEAD = "### System:\n"
GAP = "\n\n"

# Lower ends of the length ranges, the last one open.
LENGTH_RANGES = (1, 128, 256, 512, 1024, 2048, 4096, 8192)
ROLES = ("system", "user", "assistant")

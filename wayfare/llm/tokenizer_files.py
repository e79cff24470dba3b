"""Where the public tokenizer files are; paths are parameters of the operators, the files are never copied."""

from __future__ import annotations

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

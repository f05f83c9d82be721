"""The tokenizer file that the queries use."""

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

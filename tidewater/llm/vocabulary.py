"""Where the queries' vocabulary file is; operators take a path."""

import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

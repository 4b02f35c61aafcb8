"""The corpus queries, and their SQL where SQL can state them."""

from docloom.llm.decontaminate import OP5_SQL, op5_winnowing
from docloom.llm.jaccard import op10_jaccard_trie
from docloom.llm.language import op8_language_ecoc
from docloom.llm.lexical import OP12_SQL, op12_document_trie
from docloom.llm.lm import op1_gru_lm
from docloom.llm.packing import op4_best_two_fit
from docloom.llm.pieces import op13_sentence_pieces
from docloom.llm.sharding import op7_two_pass_shuffle
from docloom.llm.spelling import op11_spelling_tree
from docloom.llm.toxicity import op3_toxicity_ftrl
from docloom.llm.token_files import op2_token_files
from docloom.llm.threads import OP9_SQL, op9_quotation_links
from docloom.llm.topk import OP6_SQL, op6_top_k

QUERIES = {
    "op1_gru_lm": op1_gru_lm,
    "op2_token_files": op2_token_files,
    "op3_toxicity_ftrl": op3_toxicity_ftrl,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_winnowing": op5_winnowing,
    "op6_top_k": op6_top_k,
    "op7_two_pass_shuffle": op7_two_pass_shuffle,
    "op8_language_ecoc": op8_language_ecoc,
    "op9_quotation_links": op9_quotation_links,
    "op10_jaccard_trie": op10_jaccard_trie,
    "op11_spelling_tree": op11_spelling_tree,
    "op12_document_trie": op12_document_trie,
    "op13_sentence_pieces": op13_sentence_pieces,
}
ORACLE_SQL: dict[str, str] = {
    "op5_winnowing": OP5_SQL,
    "op6_top_k": OP6_SQL,
    "op9_quotation_links": OP9_SQL,
    "op12_document_trie": OP12_SQL,
}

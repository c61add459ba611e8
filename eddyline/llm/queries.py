"""The registered queries of this subpackage. op8 and op13 have SQL: fingerprints of shingles, trained models, permutations,
lattices, agendas and image formats are beyond it, so tests compare the others with brute force."""

from __future__ import annotations

from eddyline.llm import bpe, language, lattice, mixing, neighbours, quality, repair, secrets, simhash, toxicity, trie, warc, webp

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_webp": webp.op6_webp,
    "op7_simhash": simhash.op7_simhash,
    "op8_warc": warc.op8_warc,
    "op9_language": language.op9_language,
    "op10_secrets": secrets.op10_secrets,
    "op11_lattice": lattice.op11_lattice,
    "op12_repair": repair.op12_repair,
    "op13_trie": trie.op13_trie,
}
ORACLES: dict[str, str] = {"op8_warc": warc.SQL, "op13_trie": trie.SQL}

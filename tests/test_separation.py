"""Without the corpus operators the rest imports and keeps its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_corpus_operators(tmp_path):
    for name in ("docloom", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kie_document_metrics' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)"
    for with_pipeline in (False, True):
        if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_without_the_tokenizer_files(tmp_path):
    """What the corpus operators import may be missing altogether."""
    for name in ("tokenizers", "public_tokenizers", "zstandard"):
        (tmp_path / f"{name}.py").write_text(f"raise ImportError('no {name}', name='{name}')")
    code = "import __spark_entry__ as e; assert 'kie_document_metrics' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)

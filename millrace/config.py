"""Shape of the feed. Every operator takes these as parameters; nothing is read from a global."""

from __future__ import annotations

from dataclasses import dataclass

# Results must agree on these.
VOCAB = 10000
SEQ_LEN = 1024
CLASSES = 2
PAD = 0
BATCH_SIZE = 64
WORD_BYTES = 8
CAP_BYTES = 2 * 1024 * 1024
CAP_ITEMS = CAP_BYTES // 1024
STALL_S = 0.1
STATS_EVERY = 10
LEARNING_RATE = 1e-3
PHASES = ("wait", "load", "pin", "h2d", "train")
SHARD_ID_PATTERN = r"shard_(\d+)\.pt"
SHARD_NAME_PATTERN = r"^shard_[0-9]+\.pt$"
SHARD_GLOB = "shard_*.pt"
DONE_NAME = "DONE"


@dataclass(frozen=True)
class FeedConfig:
    """Dimensions both ends of a feed have to agree on."""

    batch_size: int = BATCH_SIZE
    seq_len: int = SEQ_LEN
    vocab: int = VOCAB
    classes: int = CLASSES
    pad: int = PAD
    cap_bytes: int = CAP_BYTES

    @property
    def sample_bytes(self) -> int:
        """Bytes of one sample: its token ids and its label, one word each."""
        return WORD_BYTES * (self.seq_len + 1)

    @property
    def shard_bytes(self) -> int:
        return self.batch_size * self.sample_bytes

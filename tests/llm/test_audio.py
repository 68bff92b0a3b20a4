import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from cases import FOLDER, docs, empty, prose

from docledger.llm import audio, queries


def test_stored_form_is_a_wav_file_of_the_payload():
    for text in ("", "x", "é" * 500, None, prose(1, 3000)):
        payload, n = audio.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == (text or "").encode() and not any(payload[n:])
        media = audio.store(payload)
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.SOURCE_RATE)
            assert w.readframes(w.getnframes()) == payload
        assert audio.samples_of(media) == payload


def test_polyphase_is_the_full_filter_thinned_out():
    rng = np.random.default_rng(0)
    signal = rng.standard_normal(500)
    h = audio._PHASES.T.reshape(-1)
    up = np.zeros(500 * audio.UP)
    up[:: audio.UP] = signal
    want = np.convolve(up, h)[: 500 * audio.UP : audio.DOWN]
    assert np.allclose(audio.resampled(signal, 0, len(want)), want)
    assert np.allclose(audio.resampled(signal, 101, 257), want[101:257])


def test_tone_passes_and_a_tone_above_the_band_does_not():
    t = np.arange(8000) / audio.SOURCE_RATE
    for f, least, most in ((1000, 0.6, 0.8), (7500, 0, 0.05)):
        level = np.sqrt((audio.resampled(np.sin(2 * np.pi * f * t), 500, 5000) ** 2).mean())
        assert least <= level <= most


def test_blocks_do_not_show(monkeypatch):
    samples = prose(2, 4000).encode()
    whole = audio.frame_energies(samples)
    monkeypatch.setattr(audio, "_BLOCK", 7)
    for a, b in zip(whole, audio.frame_energies(samples)):
        assert np.array_equal(a, b)


def test_hysteresis():
    energy = np.array([0, 5, 7, 5, 4, 3, 5, 5, 9, 10, 3, 0, 0, 8.0])
    # above 6 opens, below 4 closes; 5 alone opens nothing
    assert audio.segments(energy) == [(2, 5), (8, 10), (13, 14)]
    assert audio.segments(np.zeros(4)) == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op5_audio(spark, FOLDER).collect()
    assert len(rows) == 200
    seen = {}
    for r in rows:
        payload, n = audio.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(audio.store(payload)), hashlib.sha256(audio.store(payload)).hexdigest())
        assert len(r.tensor) == audio.TIMES * audio.MELS and len(r.span_start) == audio.TIMES
        assert seen.setdefault(texts[r.doc_id], r.feature) == r.feature
        assert all(a < b for a, b in zip(r.segment_start, r.segment_end))


def test_awkward_rows_and_tensors(spark):
    media = audio.with_media(docs(spark))
    assert media.columns == [*docs(spark).columns, "media", "n_bytes"]
    rows = audio.with_features(media.select("doc_id", "media")).toArrow()
    assert rows.num_rows == 15
    table = audio.tensor_table(rows)
    assert isinstance(table["tensor"].type, pa.FixedShapeTensorType) and table["tensor"].type.shape == [audio.TIMES, audio.MELS]
    assert audio.with_features(audio.with_media(empty(spark))).collect() == []

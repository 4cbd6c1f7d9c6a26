"""Reading, selecting, materialising and writing tables."""
